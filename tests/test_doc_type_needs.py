"""Types of documents: a text without the parts of a pattern isn't searched, and no match is lost by that."""

from pyspark.sql import functions as F

from tulya.functions import text as X
from tulya.functions.jsregex import java
from tulya.operators import structure
from tulya.rules import doctypes

_TEXTS = [
    "", "nothing of any rule", "ſWORN before me", "İNFORMANT and ınformant", "ſection 302 IPC", "SCC ONLİNE", "C.O. No. 12/2024 crl. a 5/2023 S.O. No. 7/1999",
    "dated 1/2/2024", "GR No. 12/24-5", "MANU 12 LD 7 tp 12", "GD No. and General Diary, s/2024, R/No.", "charge-sheet chargesheet arresting memo",
    "I, abc, s/o def", "Section 437A CrPC bails for the accused", "Writ of Certiorari; ARTICLE 226", "adhÉsion stamp", "HON'BLE JUSTICE J: JUDGE",
    "સબ-રજિસ્ટ્રાર પ્રકાર: વેચાણ અરજીનો નિરાખ ફરિયાદ નોંધણી", "within seven days Whereas SDO I.O.P.B. 7/12 8-A Police Station", "લગ્ન વૈધ નોટિસ",
    "represented by X Advocate; complainant u/s 5; prays that the complaint", "learnt APP for the Petitioner prays; petitioner is acquitted", "Plots number survey no",
]


def test_no_match_is_lost(spark):
    df = spark.createDataFrame([(t,) for t in _TEXTS], "t string")
    rules = [(rx, flags == "i") for _, _, patterns in doctypes.RULES for rx, flags in patterns]
    gated = F.array(*(structure._counted(F.col("t"), X.any_case("t"), rx, i) for rx, i in rules))
    plain = F.array(*(F.regexp_count("t", F.lit(java(rx, i))) for rx, i in rules))
    rows = df.select("t", gated.alias("a"), plain.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert sum(map(bool, (n for r in rows for n in r.b))) >= 40
