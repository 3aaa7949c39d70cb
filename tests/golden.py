"""Small fixed inputs whose results follow from the rules; the SQL lists what has to come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tulya.functions import text as X
from tulya.operators import datums, offline, replies, structure, terms, verify
from tulya.operators.english import normalize_target
from tulya.plans import run as batch
from tulya.sources import office, readers, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _quoted(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def golden(inputs: str, cases: list[tuple], expected: list[str]):
    """A query of cases. A case holds the inputs (names and types, an id is put before) and what is expected."""
    n = len(inputs.split(","))
    rows = ", ".join(f"({i}, {', '.join(map(_quoted, case[n:]))})" for i, case in enumerate(cases))

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(spark.createDataFrame([(i, *case[:n]) for i, case in enumerate(cases)], f"id int, {inputs}"))

        QUERIES[f.__name__] = run
        SQL[f.__name__] = f"select cast(id as int) as id, {', '.join(expected)} from (values {rows}) as v(id, {', '.join(expected)})"
        return f

    return add


def _listed(rows: DataFrame, order: list[str], value, name: str, sep: str = "|") -> DataFrame:
    """id, name: the values of an id in order, joined."""
    cut = rows.select("id", F.struct(*order, value.alias("_v")).alias("_s")).groupBy("id").agg(F.array_sort(F.collect_list("_s")).alias("_l"))
    return cut.select("id", F.array_join(F.transform("_l", lambda s: s["_v"]), sep).alias(name))


@golden("text string", [
    ("આજે વરસાદ છે. કાલે તડકો હશે.", "આજે વરસાદ છે.|કાલે તડકો હશે."),
    ("આજે વરસાદ છે। કાલે તડકો હશે।", "આજે વરસાદ છે।|કાલે તડકો હશે।"),
    ("લીટી\nબીજી\nછેલ્લી", "લીટી|બીજી|છેલ્લી"),
    ("ભાડું રૂ. ૯,૨૦૦ ભરવાનું છે.", "ભાડું રૂ. ૯,૨૦૦ ભરવાનું છે."),
    ("તા. 05/11/2019 લખાયું.", "તા. 05/11/2019 લખાયું."),
    ("મુ. રાજકોટ ગયા. પાછા આવ્યા.", "મુ. રાજકોટ ગયા.|પાછા આવ્યા."),
    ("આવો. જુઓ! કેમ?", "આવો.|જુઓ!|કેમ?"),
    ("Read Art. 14 first. Then stop.", "Read Art. 14 first.|Then stop."),
    ("Costs are Rs. 750/- (Rupees Seven Hundred Fifty).", "Costs are Rs. 750/- (Rupees Seven Hundred Fifty)."),
    ("", ""), (" \n ", ""), (None, ""), ("b\u0001c. d", "b c.|d"),
], ["sentences"])
def sentences_golden(df: DataFrame) -> DataFrame:
    return df.select("id", F.coalesce(F.array_join(X.split_sentences("text"), "|"), F.lit("")).alias("sentences"))


@golden("text string", [
    ("ભાડું રૂ. ૯,૨૦૦ છે.", "currency:9200"),
    ("કુલ ૩,૪૫,૦૦૦/-", "currency:345000"),
    ("Axis Bank 27/09/2021 400123 3,45,000/-", "place:axisbank|date:2021-09-27|number:400123|currency:345000"),
    ("Section 41 BNS", "section_ref:Section 41|statute:BNS"),
    ("તારીખ 06/02/2021 લખાઈ.", "date:AMBIG:2021-06-02|2021-02-06"),
    ("તારીખ 19/02/2021 લખાઈ.", "date:2021-02-19"),
    ("૭.૨૫ ટકા વ્યાજ.", "percentage:7.25"),
    ("11:45 pm", "time:45:undefined"),
    ("PIN 395007", "case_number:PIN395007"),
    ("xy Rs. 620 \u0001c 02/08/2022", "currency:620|date:AMBIG:2022-02-08|2022-08-02"),
    ("Smt. Leela Joshi paid nine", "person_name:leelajoshi|count_phrase:9"),
    ("none of it", None), ("", None), (None, None),
], ["facts"])
def facts_golden(df: DataFrame) -> DataFrame:
    found = datums.extract_datums(df, "text", "s", ["id"])
    return df.select("id").join(_listed(found, ["ord"], F.concat_ws(":", "kind", "normalized"), "facts"), "id", "left")


@golden("text string", [
    ("ફરિયાદકર્તા શ્રી મોહનલાલ દવે", "શ્રી મોહનલાલ દવે", "ફરિયાદકર્તા"),
    ("જમીનર હેઠળની વાડીનો નકશો જોડેલ છે.", None, None),
], ["party", "role"])
def parties_golden(df: DataFrame) -> DataFrame:
    found = datums.extract_datums(df, "text", "s", ["id"]).filter("kind = 'party_name'")
    return df.select("id").join(found.select("id", F.col("surface").alias("party"), "role"), "id", "left")


@golden("sk string, ss string, sn string, tk string, ts string, tn string", [
    ("currency", "72000", "72000", "currency", "7200", "7200", "changed"),
    ("section_ref", "Section 41 BNS", "Section 41 BNS", "section_ref", "Section 41 of BNS", "Section 41 of BNS", "agreed"),
    ("section_ref", "Section 41 BNS", "Section 41 BNS", "section_ref", "Section 42 BNS", "Section 42 BNS", "changed"),
    ("date", "06/02/2021", "AMBIG:2021-06-02|2021-02-06", "date", "2 June 2021", "2021-06-02", "ambiguous"),
    ("date", "06/02/2021", "AMBIG:2021-06-02|2021-02-06", "date", "9 May 2021", "2021-05-09", "missing"),
    ("number", "72000", "72000", "currency", "72000", "72000", "missing"),
    ("place", "રાજ્યના ન્યાયાલયના", "rajynanyayalyna", "place", "The Court", "thecourt", "agreed"),
    ("place", "જિલ્લા ન્યાયાલય", "jillanyayaly", "place", "High Court", "highcourt", "changed"),
    ("person_name", "શાહ મહેશ", "shahmhesh", "person_name", "Shah Mahesh", "shahmahesh", "agreed"),
    ("person_name", "Shah Mahesh", "shahmahesh", "person_name", "Dave Mohan", "davemohan", "missing"),
    ("party_name", "શાહ મહેશ", "shahmhesh", "person_name", "Shah Mahesh", "shahmahesh", "agreed"),
], ["status"])
def agreement_golden(df: DataFrame) -> DataFrame:
    side = lambda k, s, n: df.select(
        "id", F.col(k).alias("kind"), F.col(s).alias("surface"), F.col(n).alias("normalized"), F.lit(0).alias("ord"),
        F.lit("critical").alias("severity"), F.lit("").alias("context"),
    )
    blocks = df.select("id", F.lit(False).alias("target_blank"))
    return datums.match_datums(side("sk", "ss", "sn"), side("tk", "ts", "tn"), blocks, ["id"]).filter("side = 's'").select("id", "status")


@golden("source_text string, target_text string", [
    ("તા. 06/02/2021 લખાયેલ છે.", "It was written on 06/02/2021.", "datum.date_ambiguous:major"),
    ("તા. 06/02/2021 લખાયેલ છે.", "It was written on 2021-02-06.", "datum.date_ambiguous:major"),
    ("તા. 06/02/2021 લખાયેલ છે.", "It was written.", "datum.date_missing:critical"),
    ("ભાડું રૂ. ૯,૨૦૦ થાય છે.", "The rent is Rs. 9,200.", None),
    ("ભાડું રૂ. ૯,૨૦૦ થાય છે.", "The rent is Rs. 92,000.", "datum.currency_changed:critical"),
    ("The heirs were entered on 21/08/1990. The scheme is dated 13/07/1984.", "The entry is dated 18/07/1985 and was confirmed on 24/10/1990.",
     "datum.date_added:major|datum.date_added:major|datum.date_missing:critical|datum.date_missing:critical"),
    ("The deed is dated 21/08/1990.", "The deed is dated 24/10/1990.", "datum.date_changed:critical"),
    ("વેચાણ અવેજ રૂ. ૬,૨૦,૦૦૦/- છે. કોષ્ટકમાં ૬,૨૦,૦૦૦/- અને વળી ૬,૨૦,૦૦૦/- લખેલ છે.", "The consideration is Rs. 6,20,000/-. The table shows 6,20,000/-.", None),
], ["checks"])
def block_checks_golden(df: DataFrame) -> DataFrame:
    s, t = (datums.extract_datums(df, f"{x}_text", x[0], ["id"]) for x in ("source", "target"))
    found = datums.datum_findings(datums.match_datums(s, t, df.select("id", F.lit(False).alias("target_blank")), ["id"]), ["id"])
    rows = found.select("id", F.concat_ws(":", "check", "severity").alias("c"))
    return df.select("id").join(_listed(rows, ["c"], F.col("c"), "checks"), "id", "left")


_AFFIDAVIT = [
    ("સોગંદનામું", "Affidavit (sworn statement in writing)", "document", True, [], []),
    ("અરજી", "application", "document", False, [], []),
]


@golden("plan_text string, source_text string, target_text string", [
    ("સોગંદનામું જોડેલ છે.", "સોગંદનામું જોડેલ છે.", "This Affidavit (sworn statement in writing) is attached.", None),
    ("સોગંદનામું જોડેલ છે.", "સોગંદનામું જોડેલ છે.", "The Affidavit runs to page 12.", None),
    ("સોગંદનામું જોડેલ છે.", "સોગંદનામું જોડેલ છે.", "This paper is attached.", "not_present:(absent)"),
    ("સોગંદનામું જોડેલ છે.", "સોગંદનામું જોડેલ છે.", "This sworn statement is attached.", "literal_translation:sworn statement"),
    ("અરજી મળી છે.", "અરજીકર્તાએ કહ્યું.", "It was said.", None),
], ["kinds"])
def terms_golden(df: DataFrame) -> DataFrame:
    glossary = terms.glossary(df.sparkSession, _AFFIDAVIT)
    blocks = df.withColumns({"doc_id": F.col("id"), "block_ord": F.lit(0)})
    plan = terms.term_plan(terms.term_scan(blocks, glossary, "plan_text"), glossary)
    found = terms.term_compliance(plan, blocks).select(F.col("doc_id").alias("id"), F.concat_ws(":", "kind", "actual").alias("kinds"))
    return df.select("id").join(found, "id", "left")


@golden("a string, b string", [
    ("શાહ મહેશ", "Shah Mahesh", True), ("Shah Mahesh", "Dave Mohan", False), ("Dave Mohan", "Dave Mohan", True), ("", "Dave", False),
], ["match"])
def names_golden(df: DataFrame) -> DataFrame:
    return df.select("id", X.names_match("a", "b")["match"].alias("match"))


@golden("s array<string>, t array<string>", [
    (["લીટી.", "બીજી."], ["Line.", "Second."], "0-0|1-1", "", "", True),
    (["red apple", "green pear", "blue plum"], ["red fruit", "blue fruit"], "0-0|2-1", "1", "", False),
    (["x", "y", "z"], [], "", "0|1|2", "", False),
    ([], [], "", "", "", True),
], ["pairs", "lost", "made", "exact"])
def alignment_golden(df: DataFrame) -> DataFrame:
    out = verify.align(df, "s", "t", "id")
    joined = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), "|")
    pairs = F.array_join(F.transform(F.array_sort("pairs"), lambda p: F.concat_ws("-", p["src"], p["tgt"])), "|")
    return out.select("id", pairs.alias("pairs"), joined("unmatched_source").alias("lost"), joined("unmatched_target").alias("made"), "exact")


@golden("s string, t string", [
    ("કુલ ભાડું ૯૨૫૦.૦૦", "Total Rs. 9,250", "", "9250"),
    ("કુલ ભાડું 9250.00 અને દંડ 310.00", "All of it was settled.", "9250.00|310.00", ""),
    ("ખેતરની માપણી", "The field measures 2750.50 sq. m. in all.", "", "275050"),
], ["lost", "made"])
def numbers_golden(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_join(X.lost_numbers("s", "t"), "|").alias("lost"), F.array_join(X.foreign_numbers("s", "t"), "|").alias("made"))


@golden("html string", [
    ("<p><strong>SEARCH NOTE</strong></p>", "SEARCH NOTE"),
    ("<p></p><table><tr><td>cell</td></tr></table>", "cell"),
    ('<p>one</p><p style="page-break-before: always">two</p>', "one|two"),
    ("<p>X &amp; Y &lt;Z&gt; &quot;W&quot;</p>", 'X & Y <Z> "W"'),
    ("<ol><li><strong>Owner</strong>: </li><li>next</li></ol>", "Owner:|next"),
], ["paragraphs"])
def html_golden(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_join(readers.html_paragraphs(F.col("html")), "|").alias("paragraphs"))


@golden("source string, target string", [
    ("ગામનું નામ: લુવારા", "The village Rasa and Luvawara.", "The village Luvara and Luvara."),
    ("રે.સ.નં.: 83, બ્લોક નં.: 120(જુનો), 145(નવો)", "Road No.: 83, Block No.: 120(Junoo), 145(Navoo).", "Revenue Survey No.: 83, Block No.: 120(old), 145(new)."),
    ("અવેજ ની રકમ રૂ. 17,58,000 (સત્તર લાખ અઠ્ઠાવન હજાર)", "Consideration of Rs. 18,58,000 (Eighteen lakh fifty eight thousand only).", "Consideration of Rs. 17,58,000 (Seventeen lakh fifty eight thousand only)."),
    ("એક લીટી", "A plain line.", "A plain line."),
], ["english"])
def english_golden(df: DataFrame) -> DataFrame:
    return df.select("id", normalize_target(F.col("target"), F.col("source"), F.lit(0.95)).alias("english"))


@golden("text string", [
    ("તાલુકા કોર્ટx no. 4\nબીજી લીટી", "court_name|body|body"),
    ("તાલુકા કોર્ટ\nબીજી લીટી", "body|body"),
    ("આદેશ\nHe said so.\n1. First\n1.2 Second\n• item\n- 3 -", "heading_1|body|sub_clause|sub_clause|list_item|footer"),
    ("CRA No. 12/2020\nSection 302 of the code is cited in this line of some length only to be long", "case_number|body"),
    ("SD/F\nન્યાયાલય છાપ", "signature_block|seal_note"),
], ["kinds"])
def structure_golden(df: DataFrame) -> DataFrame:
    blocks = structure.detect_structure(readers.pages(df, "id", "text")).withColumn("id", F.col("doc_id"))
    return _listed(blocks, ["block_ord"], F.col("kind"), "kinds")


@golden("name string", [
    ("Khushi Ghosh", "kusigos"), ("Meena Joshi", "menajosi"), ("મહેશ", "mhes"), ("દવે", "dve"), ("", ""),
], ["key"])
def name_keys_golden(df: DataFrame) -> DataFrame:
    return df.select("id", X.name_key("name").alias("key"))


@golden("raw string", [
    ('```json\n{"segments": [{"id": 3, "target": "x"}]}\n```', "3=x"),
    ('Here you are: {"segments": {"0": {"text": "a"}, "1": {"translation": "b"}}} Done.', "0=a|1=b"),
    ('{"segments": [{"id": "[7]", "target": "y", "confidence": 0.5}, {"index": 8, "text": "z"}, {"target": "w"}]}', "2=w|7=y|8=z"),
    ('{"segments": [{"id": 1, "target": "first"}, {"id": 1, "target": "last"}]}', "1=last"),
    ("no json at all", None), ("", None), (None, None), ('{"segments": null}', None),
], ["targets"])
def replies_golden(df: DataFrame) -> DataFrame:
    rows = replies.reply_targets(df.withColumnRenamed("id", "reply"), "raw", ["reply"])
    listed = _listed(rows.select(F.col("reply").alias("id"), F.col("id").alias("n"), "target"), ["n"], F.concat_ws("=", "n", "target"), "targets")
    return df.select("id").join(listed, "id", "left")


@golden("raw string", [
    ('{"a": 1}', '{"a": 1}'), ('text [1, 2] more', "[1, 2]"), ('x {"b": 2} y', '{"b": 2}'), ("```\n[3]\n```", "[3]"), ("{broken", None), ("  ", None), (None, None),
], ["json"])
def loose_json_golden(df: DataFrame) -> DataFrame:
    return df.select("id", replies.loose_json(F.col("raw")).alias("json"))


@golden("n int, source string, target string, hint string", [
    (0, "એક", "One", None, "0:એક:One"), (12, "બે\nત્રણ", "Two three", "term", "12:બે\nત્રણ:Two three"),
], ["pairs"])
def judge_pairs_golden(df: DataFrame) -> DataFrame:
    hints = F.filter(F.array("hint"), lambda h: h.isNotNull())
    shown = df.select("id", replies.judge_pairs(F.concat(replies.judge_pair(F.col("n"), F.col("source"), F.col("target"), hints), F.lit("\n\n## Output\nJSON only."))).alias("p"))
    return shown.select("id", F.array_join(F.transform("p", lambda p: F.concat_ws(":", p["id"], p["source"], p["target"])), "|").alias("pairs"))


@golden("batch int, n int, verdict int", [
    (0, 0, 0, 10), (0, 1, 1, 11), (0, 2, 12, 12), (1, 0, 13, 13), (1, 1, 1, 14), (1, 2, 99, None),
], ["block"])
def judge_ids_golden(df: DataFrame) -> DataFrame:
    asked = df.select(F.lit(1).alias("doc_id"), "batch", F.col("n").alias("place"), (F.lit(10) + F.col("batch") * 3 + F.col("n")).alias("block_idx"), F.lit(20).alias("n_blocks"))
    given = df.select(F.lit(1).alias("doc_id"), "batch", F.col("verdict").alias("id"), F.col("id").alias("case"))
    out = replies.reconciled(given, asked, ["doc_id"]).select(F.col("case").alias("id"), F.col("block_idx").alias("block"))
    return df.select("id").join(out, "id", "left")


_HEADS = {"સોગંદનામું": "Affidavit", "કલમ": "Section"}


@golden("source string", [
    ("સોગંદનામું અહીં છે.", "Affidavit is."),
    ("આ કલમ 41 ની સંબંધમાં છે.", "This Section 41 of is."),
    ("Section 41 BNS અને 19/02/2021", "Section 41 BNS and 19/02/2021 ."),
    ("હાજર માર્ચ!", "Present March!"),
    ("", ""), (None, ""),
], ["target"])
def render_golden(df: DataFrame) -> DataFrame:
    return offline.rendered(df, _HEADS).select("id", "target")


@golden("fault string", [
    ("none", "A 7 b|B 8|C|D (x)"), ("drop_sentence", "A 7 b||C|D (x)"), ("change_number", "A 8 b|B 8|C|D (x)"), ("literalize_term", "A 7 b|B 8|C|D (x)"),
], ["targets"])
def faults_golden(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("id").alias("doc_id"), "fault", F.posexplode(F.array(*map(F.lit, ("A 7 b", "B 8", "C", "D (x)")))).alias("seg_idx", "target"))
    out = None
    for fault in ("none", "drop_sentence", "change_number", "literalize_term"):
        one = offline.with_fault(rows.filter(F.col("fault") == fault), fault)
        out = one if out is None else out.unionByName(one)
    return _listed(out.withColumn("id", F.col("doc_id")), ["seg_idx"], F.col("target"), "targets")


@golden("source string, target string", [
    ("એક", "One", "One", True), ("એક ", "Two", "One", False), ("બે", "", "", True),
], ["reference", "faithful"])
def pairs_golden(df: DataFrame) -> DataFrame:
    known = df.sparkSession.createDataFrame([("એક", "One")], "source string, reference string")
    told = offline.from_pairs(df, known).select("id", F.col("target").alias("reference"))
    return told.join(offline.judged_by_pairs(df, known).select("id", "faithful"), "id")


@golden("line1 string, line2 string", [
    ("TITLE REPORT", "Rs. 5,000/- (paid) \\ done", "TITLE REPORT|Rs. 5,000/- (paid) \\ done", "TITLE REPORT\nRs. 5,000/- (paid) \\ done"),
    ("a < b & c", "é", "a < b & c|é", "a < b & c\né"),
], ["docx", "pdf"])
def office_golden(df: DataFrame) -> DataFrame:
    """Written as DOCX and PDF, and read back."""
    docs = df.withColumn("lines", F.array("line1", "line2"))
    files = {kind: office.exported(docs, "lines", kind, "id").select(F.col("id").cast("string").alias("path"), "content") for kind in ("docx", "pdf")}
    word = office.docx_pages(files["docx"]).select(F.col("doc_id").cast("int").alias("id"), F.replace(F.col("text"), F.lit("\n"), F.lit("|")).alias("docx"))
    pdf = office.pdf_text(files["pdf"]).select(F.col("doc_id").cast("int").alias("id"), F.col("text").alias("pdf"))
    return word.join(pdf, "id")


_DEED = ["શ્રી મહેશ શાહ, સરદાર માર્ગ, સુરત.", "આ સોગંદનામું તારીખ 19/02/2021 ના રોજ આપવામાં આવ્યું છે.",
         "ભાડું રૂ. ૯,૨૦૦ થાય છે.", "આ કાયદો કલમ 41 ની સંબંધમાં છે."]


@golden("text string", [
    ("\n".join(_DEED), 4, 4, "red", 22), ("\n".join(_DEED), 4, 4, "red", 22),
], ["n_blocks", "n_segments", "grade", "n_sections"])
def run_golden(df: DataFrame) -> DataFrame:
    """The whole run over two equal documents: no keys collide, and both come to the same verdict."""
    glossary = terms.glossary(df.sparkSession)
    out = batch.run(readers.pages(df, "id", "text"), glossary, keep=scratch.kept)
    n = out["blocks"].groupBy("doc_id").agg(F.count("*").cast("int").alias("n_blocks"))
    scores = out["scores"].select("doc_id", F.col("n_segments").cast("int").alias("n_segments"), "grade")
    heads = out["reports"].select("doc_id", F.size(F.filter("items", lambda i: i["t"] == "h2")).alias("n_sections"))
    return n.join(scores, "doc_id").join(heads, "doc_id").withColumnRenamed("doc_id", "id")
