"""Text functions on the examples that define them."""

import pytest
from pyspark.sql import functions as F

from tulya.functions import text as X
from tulya.functions.jsregex import java
from tulya.operators import structure
from tulya.operators.english import normalize_target
from tulya.sources import readers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [
    ("પહેલું વાક્ય. બીજું વાક્ય.", ["પહેલું વાક્ય.", "બીજું વાક્ય."]),
    ("પહેલું વાક્ય। બીજું વાક્ય।", ["પહેલું વાક્ય।", "બીજું વાક્ય।"]),
    ("એક\nબે\nત્રણ", ["એક", "બે", "ત્રણ"]),
    ("અતિકાલમાં ચુકવણી રૂ. ૫૦,૦૦૦ સમાનનો દંડ થાય છે.", ["અતિકાલમાં ચુકવણી રૂ. ૫૦,૦૦૦ સમાનનો દંડ થાય છે."]),
    ("શ્રી શાહ હતા. તેઓ ગયા.", ["શ્રી શાહ હતા.", "તેઓ ગયા."]),
    ("એક. બે! ત્રણ?", ["એક.", "બે!", "ત્રણ?"]),
    ("See Sec. 302 of the IPC. It applies.", ["See Sec. 302 of the IPC.", "It applies."]),
    ("   \n  ", []),
])
def test_sentences(spark, text, want):
    assert one(spark, X.split_sentences("t"), t=text) == want


def test_digits_groups_scripts(spark):
    assert one(spark, X.to_ascii_digits("t"), t="૧૨૩a") == "123a"
    assert one(spark, X.to_gujarati_digits("t"), t="120") == "૧૨૦"
    assert one(spark, X.indian_group("t"), t="1758000") == "17,58,000"
    assert one(spark, X.indian_group("t"), t="999") == "999"
    assert one(spark, X.detect_script("t"), t="abc અ") == "gujarati"
    assert one(spark, X.detect_script("t"), t="abcdef અ") == "latin"
    assert one(spark, X.detect_script("t"), t="१ क અ") == "devanagari"
    assert one(spark, X.detect_script("t"), t="12 !") == "unknown"
    assert one(spark, X.gujarati_month("t"), t="માર્ચ") == 3
    assert one(spark, X.estimate_tokens("t"), t="") == 0
    assert one(spark, X.normalize_whitespace("t"), t=" a  b \r\n\n\nc\t") == "a b\n\nc"


def test_boundaries_are_ascii(spark):
    assert one(spark, F.col("t").rlike(java(r"\bએક\b")), t="એક") is False
    assert one(spark, F.col("t").rlike(java(r"\bone\b")), t="એક one") is True


def test_names(spark):
    got = one(spark, X.names_match("a", "b"), a="શાહ રમેશ", b="Shah Ramesh")
    assert got["match"] and got["confidence"] > 0.8
    assert not one(spark, X.names_match("a", "b"), a="Shah Ramesh", b="Patel Vikram")["match"]
    assert one(spark, X.bounded_levenshtein("a", "b", 2), a="kitten", b="sitting") == 3


def test_numbers_between_sides(spark):
    assert one(spark, X.lost_numbers("a", "b"), a="કુલ રકમ ૧૮૦૮૦.૦૦", b="Total Rs. 18,080") == []
    assert one(spark, X.lost_numbers("a", "b"), a="કુલ રકમ 18080.00 અને ફી 500.00", b="The total amount was paid in full.") == ["18080.00", "500.00"]
    assert one(spark, X.foreign_numbers("a", "b"), a="આ જમીનની માપણી", b="The land measures 14406.00 sq. m.") == ["1440600"]


def test_repairs(spark):
    assert one(spark, X.restore_clause_label("t", "s"), t="Twelve. The land", s="12. જમીન") == "12. Twelve. The land"
    assert one(spark, X.strip_residue("t"), t="All good here today અ in the deed") == "All good here today in the deed"
    assert one(spark, X.last_resort_english("s"), s="જમીન Stamp Duty paid") == "Stamp Duty paid [illegible OCR removed]"
    assert one(spark, X.max_rupee("s"), s="રૂ. 5,000 અને રૂ. 17,58,000") == "17,58,000"


@pytest.mark.parametrize(("html", "want"), [
    ("<p><strong>TITLE CLEARANCE REPORT</strong></p>", ["TITLE CLEARANCE REPORT"]),
    ("<p></p><table><tr><td>a</td></tr></table>", ["a"]),
    ('<p>first</p><p style="page-break-before: always">second</p>', ["first", "second"]),
    ("<p>A &amp; B &lt;C&gt; &quot;D&quot;</p>", ['A & B <C> "D"']),
])
def test_html_paragraphs(spark, html, want):
    assert one(spark, readers.html_paragraphs(F.col("h")), h=html) == want


def test_structure_and_type(spark):
    text = "વકાલતનામું\n12. The first clause holds.\n12.1 A part of it.\n(3) another\n- an item\nordinary text that goes on for a while\npage 3"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, "x" * 2000)], "doc_id int, page_no int, text string")
    rows = structure.detect_structure(pages).orderBy("block_ord").collect()
    assert [r.kind for r in rows[:7]] == ["heading_1", "sub_clause", "sub_clause", "clause", "list_item", "body", "footer"]
    assert [len(r.source_text) for r in rows[7:10]] == [900, 900, 200] and rows[-1].source_text == "— 2 —"
    deed = spark.createDataFrame([(1, "This sale deed. Registration Fee and stamp duty. survey number 7/12"), (2, "")], "doc_id int, text string")
    got = {r.doc_id: (r.type, r.confidence) for r in structure.doc_type(deed).collect()}
    assert got[1][0] == "property_document" and got[1][1] > 0.7 and got[2] == ("other_legal", 0.0)


def test_preflight(spark):
    rows = [(1, "only latin text"), (2, "हिंदी में लिखा गया पाठ"), (3, "ગુજરાતી લખાણ")]
    out = structure.preflight(spark.createDataFrame(rows, "id int, text string"))
    got = {r.id: ([w.code for w in r.warnings], r.ok) for r in out.collect()}
    assert got == {1: (["not_indic"], True), 2: (["wrong_script"], False), 3: ([], True)}


@pytest.mark.parametrize(("source", "target", "want"), [
    ("રે.સ.નં.: 467, બ્લોક નં.: 501(જુનો), 572(નવો)", "Road No.: 467, Block No.: 501(Junoo), 572(Navoo).", "Revenue Survey No.: 467, Block No.: 501(old), 572(new)."),
    ("ગામનું નામ: લુવારા", "village Rasa and Luvawara", "village Luvara and Luvara"),
    ("ક્ષેત્રફળ 14406 ચો.મી., આકાર રૂ.1.59 પૈસા", "Area 14,406 square meters and bears 1.59 square meters.", "Area 14,406 square meters and bears an assessment of Rs. 1.59 paise."),
])
def test_english(spark, source, target, want):
    assert one(spark, normalize_target(F.col("t"), F.col("s")), t=target, s=source) == want
    assert one(spark, normalize_target(F.col("t"), F.col("s")), t=want, s=source) == want


def test_ocr_words_and_uploads(spark):
    tsv = "h\n" + "\t".join(["5"] + ["0"] * 9 + ["90", "Hello"]) + "\n" + "\t".join(["5"] + ["0"] * 9 + ["-1", "x"]) + "\n" + "\t".join(["5"] + ["0"] * 9 + ["70", "World"])
    df = spark.createDataFrame([(1, tsv), (2, "h")], "id int, t string")
    got = {r.doc_id: (r.text, r.confidence) for r in readers.ocr_words(df, "id", "t").collect()}
    assert got == {1: ("Hello World", 80.0), 2: ("", -1.0)}
    codes = spark.createDataFrame([("a.pdf", 1), ("a.exe", 1), ("a.txt", 1 << 30)], "p string, n long").select(readers.accepted_upload(F.col("p"), F.col("n")).alias("c"))
    assert [r.c for r in codes.collect()] == [201, 400, 413]
