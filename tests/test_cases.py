"""Functions and contracts on rows written out here, with the results that they must have."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselode.functions import cells, dates, html, keys, text, urls
from caselode.operators import contracts, images

CASES = {}


def cases(name, schema, rows, want, build):
    """For each row, build(columns in order) as text must be what is wanted."""
    CASES[name] = schema, rows, want, build


def listed(x):
    return F.array_join(x, ",")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _outcome(x):
    return F.concat(x["state"], F.lit(":"), F.array_join(F.transform(x["keys"], lambda k: k["case_number"]), ","))


cases("f5_decision_kinds", "x string", [(" 전원합의체판결 ",), ("판 결",), (None,), ("중간판결",), ("재결",)], ["판결", None, None, "중간판결", "재결"], keys.decision_kind)
cases("f17_display_courts", "x string", [("서울 지법",), ("대법원",), (None,)], ["서울지방법원", "대법원", None], lambda x: keys.display_court(x, {"서울지법": "서울지방법원"}))
cases(
    "f7_decision_outcomes",
    "c string, d string, m string, k string",
    [
        ("대법원", "판결", "2000다1,2", "대법원:2000다2/대법원:2000다1"),
        (None, "전원합의체판결", None, "대법원:2000다1,2"),
        ("대법원", "판결", None, "서울지법:2000다1"),
        ("대법원", "판결", None, "대법원:x/서울지법:2000다1"),
        ("대법원", "판결", None, "서울지법:x/대법원:y"),
        ("대법원", "판결", "2000다3", "대법원:2000다1"),
        ("대법원", "판결", "2000", "대법원:2000다1"),
        ("대법원", "기타", "2000다1", "대법원:2000다1"),
        (None, "결정", None, None),
    ],
    ["KEYS:2000다1,2000다2", "KEYS:2000다1,2000다2", "CONFLICTING_DECISION_COURT:", "UNREADABLE_KEY:", "CONFLICTING_DECISION_COURT:", "CONFLICTING_DECISION_DOCKETS:", "UNREADABLE_DOCKET:", "UNKNOWN_KIND:", "KEYS:"],
    lambda c, d, m, k: _outcome(keys.decision_outcome(c, d, F.when(m.isNotNull(), F.array(m)), F.transform(F.split(k, "/"), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("court"), F.split_part(x, F.lit(":"), F.lit(2)).alias("case_number"))))),
)
cases(
    "f18_date_proposals",
    "t string, h string, m string",
    [
        ("대법원 2001. 2. 3. 선고 ★", "x 대법원 2001. 2.3. 선고", None),
        ("대법원", "대법원", None),
        ("2001. 2. 3. 2001. 2. 4.", "", None),
        ("2001. 2. 31.", "", None),
        ("2072. 1. 1.", "", None),
        ("2001. 2. 3.", "no", None),
        ("2001. 2. 3.", "2001. 2. 3.", "20011399"),
        ("2001. 2. 3.", "2001. 2. 3.", "20010204"),
        ("2001. 2. 3.", "2001. 2. 3.", "no_info"),
    ],
    ["READY", "MISSING_TITLE_DATE", "AMBIGUOUS_TITLE", "INVALID_TITLE_DATE", "SENTINEL_DATE", "TITLE_NOT_CONFIRMED_IN_HTML", "INVALID_METADATA", "METADATA_CONFLICT", "READY"],
    dates.decision_date_status,
)
_ONE, _TWO = "【변론 종결】 2001. 2. 3. 【이유】", "【변론종결일】2001. 2. 3. 2001. 2. 4"
cases(
    "f19_closing_dates",
    "t string, h string, e string",
    [("2001. 2. 3.", "", None), (_ONE, _ONE, None), (_ONE, _ONE, "2001-02-03"), (_TWO, _TWO, None), ("", "", "2001-02-03"), (_ONE, _ONE, "2001-02-04"), (_ONE, "", None), ("【변론종료】 2001. 13. 1.", "", None)],
    ["NOT_FOUND", "READY", "READY", "REVIEW_MULTIPLE", "EXISTING_DATE_NOT_REPRODUCED", "EXISTING_DATE_CONFLICT", "NOT_CONFIRMED_IN_HTML", "INVALID_DATE"],
    lambda t, h, e: dates.closing_date_status(t, h, e.cast("date")),
)
cases("f29_sorted_objects", "x string", [('{"b":1,"a":"x"}',), ("[1]",), (None,), ("plain",)], ['{"a":"x","b":"1"}', "[1]", None, "plain"], cells.sorted_object)
cases("f31_joined_urls", "b string, r string", [("https://a.example/b/c", "../d"), ("https://a.example/b/", "//h/x"), ("https://a.example/", None), ("https://a.example/p?q=1", "#f")], ["https://a.example/d", "https://h/x", None, "https://a.example/p?q=1#f"], lambda b, r: urls.joined()(b, r))
cases("f32_mapping_urls", "a string, b string", [("x 1.png", "x 1.png"), ("x.png", "y.png"), (None, None)], ["https://h/?f=x+1.png", None, None], lambda a, b: urls.unique_mapping_url(F.array_compact(F.array(a, b)), "https://h/?f="))
cases("f34_contexts", "x string, a int, b int", [("0123456789", 3, 5), ("ab", 0, 2), ("가나다😀라", 3, 4)], ["12|56", "|", "나다|라"], lambda x, a, b: F.concat_ws("|", *text.context(x, a, b, 2)))
cases("f35_common_evidence", "a string, b string", [("abcde", "xbcdy"), ("x", "y"), (None, "y"), ("판결 2001", "결 2002")], ["bcd", "", None, "결 200"], lambda a, b: html.evidence_udf()(a, b))
cases("f39_id_texts", "x double", [(3.0,), (2.5,), (None,), (1234567.0,)], ["3", "2.5", None, "1234567"], keys.id_text)
cases(
    "f40_image_types",
    "x string",
    [("FFD8FFE000104A46",), ("89504E470D0A1A0A0000",), ("474946383961",), ("524946460000000057454250",), ("424D0000",), ("52494646",), ("",), (None,)],
    ["jpeg", "png", "gif", "webp", "bmp", None, None, None],
    lambda x: images.sniff(F.unhex(x)),
)
cases("f41_same_numbers", "a string, b string", [("ImageId12", "img12"), ("ImageId1", "img12"), ("a", "b"), ("x7.PNG", "y7"), (None, "1")], ["true", "false", "false", "true", None], images.same_number)
cases("f42_text_built_ins", "x string", [(" a,b ",), ("pre:x",), (None,)], ["a", "pre:x", "-"], lambda x: F.coalesce(F.split_part(F.trim(x), F.lit(","), F.lit(1)), F.lit("-")))
cases(
    "f45_exact_metadata",
    "c string, d string, k string, day string, c2 string, d2 string, k2 string, day2 string",
    [
        ("대 법원", "2000다1,2", "판결", "2001.02.03", "대법원", "2000다2,2000다1", "전원합의체판결", "20010203"),
        ("대법원", "2000다1", "판결", "20010203", "대법원", "2000다2", "판결", "20010203"),
        ("대법원", None, "판결", "20010203", "대법원", None, "판결", "20010203"),
        ("대법원", "2000다1", "판결", "2001", "대법원", "2000다1", "판결", "2001"),
    ],
    ["true", "false", "false", "false"],
    lambda c, d, k, day, c2, d2, k2, day2: keys.exact_metadata({"court": c, "dockets": d, "kind": k, "day": day}, {"court": c2, "dockets": d2, "kind": k2, "day": day2}),
)
cases("f47_dated_spans", "x string", [("선고 2001. 2. 3. 과 2001. 2. 31.",), ("없음",), (None,)], ["3-14=2001-02-03;17-29=?", "", None], lambda x: F.array_join(F.transform(dates.dated_spans_udf()(x), lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit("="), F.coalesce(s["date"], F.lit("?")))), ";"))
cases("f48_large_integers", "x string", [("9223372036854775807",), ("9223372036854775808",), (None,)], ["INTEGER:9223372036854775807", "BIG_INTEGER:9223372036854775808", "NULL:"], lambda x: F.concat(cells.tag(T.DecimalType(38, 0), x.cast("decimal(38,0)"))["encoding"], F.lit(":"), F.coalesce(cells.untag(cells.tag(T.DecimalType(38, 0), x.cast("decimal(38,0)"))), F.lit(""))))
cases("f49_lenient_numbers", "x string", [(" 7 ",), ("x",), ("",), (None,), ("-3",)], ["7", None, None, None, "-3"], cells.whole_number)
cases("f49_scalar_texts", "x string", [(" a ",), ("  ",), (None,)], ["a", None, None], cells.scalar_text)
cases("f50_query_files", "x string", [("https://h/p?attachImgNm=a%20b.png&x=1",), ("https://h/p",), (None,)], ["a b.png", None, None], lambda x: urls.file_name(x, "attachImgNm"))
cases("f51_wrapped_values", "x string", [('{"value": 12}',), ("{broken",), ("7",), (None,)], ["12", "{broken", "7", None], cells.wrapped_value)
cases("f52_compact_days", "x string", [("20240229",), ("20230229",), ("2024-02-29",), (None,)], ["2024-02-29", None, None, None], dates.compact_day)
cases("c1_artifacts", "i string, p string, k string, r string", [("a", "p", "blobs/aa/bb", "TEXT"), ("a", "a", "../x", "TEXT"), ("a", None, "ok", "TEXT"), ("a", None, "ok", "RESPONSE_BYTES")], ["", "INVALID_STORAGE_KEY,SELF_PARENT_ARTIFACT", "MISSING_PARENT_ARTIFACT", ""], lambda i, p, k, r: listed(contracts.artifact(i, p, k, r)))
cases("c2_acquisitions", "s string, a string, f string", [("ACQUIRED", "x", None), ("ACQUIRED", None, None), ("FAILED", None, "e"), ("FAILED", "x", "e"), ("PENDING", None, None), ("PENDING", "x", None)], ["true", "false", "true", "false", "true", "false"], contracts.acquired_iff)
cases("c4_blocks", "b string, p string, a string, s string, k string, x string", [("1", "2", "a", "a", "text", None), ("1", "1", "a", "b", "image", None), ("1", None, "a", None, "image", "x")], ["", "SELF_PARENT_BLOCK,BLOCK_ARTIFACT_MISMATCH,MISSING_ASSET_REFERENCE", ""], lambda *x: listed(contracts.block(*x)))
cases(
    "c4_fidelity",
    "t string, v boolean, n int, d string, s string, o boolean",
    [("SCAN", None, None, "UNKNOWN", None, True), ("SCAN", True, 2, "COMPLETE", "all", True), ("FULL_TEXT", False, 0, "PARTIAL", "all", None), ("SCAN", True, 0, "COMPLETE", None, None)],
    ["", "", "INCOMPLETE_NEGATIVE_DETECTION", "MISSING_DETECTION_SCOPE,CONFLICTING_VISUAL_COUNT,SCAN_REQUIRES_OCR"],
    lambda t, v, n, d, s, o: listed(contracts.fidelity(t, v, n, d, s, o, F.lit("NOT_YET_PROCESSED"))),
)
cases("c7_gold", "s string, c string, b string", [("ELIGIBLE", ",".join(contracts.GOLD_CHECKS), None), ("ELIGIBLE", "schema", None), ("INELIGIBLE", "schema", None), ("INELIGIBLE", "schema", "x")], ["", "INCOMPLETE_GOLD_ASSESSMENT", "MISSING_GOLD_BLOCKER", ""], lambda s, c, b: listed(contracts.gold(s, F.split(c, ","), F.array_compact(F.array(b)))))
cases("c8_evidence", "t string, a int, b int, q string, v boolean", [("abcd", 1, 3, "bc", True), ("abcd", 1, 3, "xx", False), (None, 1, 3, "bc", True), ("abcd", 3, 9, "d", True)], ["", "EVIDENCE_SOURCE_VERSION_MISMATCH,TEXT_SPAN_MISMATCH", "EVIDENCE_SOURCE_NOT_LOADED", "TEXT_SPAN_MISMATCH"], lambda *x: listed(contracts.evidence(*x)))
cases("c9_inventories", "c string, n int, t int, o int, b string, f int, s int, e int, r int", [("COMPLETE", 2, 2, 2, "basis", 0, 1, 2, 3), ("COMPLETE", 2, 3, 2, None, 1, 1, 2, 1), ("PARTIAL", 2, None, 1, None, 1, 1, 2, 2)], ["", "INVALID_INVENTORY_TIMES,UNPROVEN_COMPLETE_INVENTORY,INCOMPLETE_INVENTORY_COUNT", "INVENTORY_COUNT_MISMATCH"], lambda *x: listed(contracts.inventory(*x)))
cases("c10_legacy_records", "i string, s string, p int, k string, b string, st string", [("legacy-row:h:3", "h", 3, "a,b", "x", "PRESERVED"), ("legacy-row:h:4", "h", 3, "a,a", "", "PRESERVED")], ["", "LEGACY_PRESERVATION_ID_MISMATCH,DUPLICATE_SOURCE_KEY,LEGACY_BODY_STATE_MISMATCH"], lambda i, s, p, k, b, st: listed(contracts.legacy_record(i, s, p, F.split(k, ","), b, st)))
cases("c12_check_rules", "d string, n int, r int, u string, s double", [(sha("x"), 0, 1, "https://a.example/", 0.5), ("zz", -1, 0, "ftp://a/", 1.5), (None, None, None, None, None)], ["", "digest,count,revision,url,score", "digest,count,revision,url,score"], lambda d, n, r, u, s: listed(contracts.reasons(digest=contracts.digest(d), count=contracts.count_value(n), revision=contracts.revision_value(r), url=contracts.safe_url(u), score=contracts.score(s))))
cases("c16_decision_keys", "c string, n string, k string", [("대법원", "2000다1", "판결"), (" 대법원", "다1", "기타"), (None, None, None)], ["", "COURT_SPELLING,CASE_NUMBER_SPELLING,UNKNOWN_KIND", "COURT_SPELLING,CASE_NUMBER_SPELLING,UNKNOWN_KIND"], lambda c, n, k: listed(contracts.decision_key(c, n, k)))
cases("c17_structured_spans", "t string, a int, b int, p string", [("abc", 1, 2, "b"), ("abc", 1, 9, "b"), ("가나다", 1, 3, "나다"), (None, 0, 1, "a")], ["true", "false", "true", None], contracts.span_holds)
cases("d13_outcomes", "s string, n int, c boolean", [("EXACT", 1, True), ("EXACT", 1, False), ("AMBIGUOUS", 1, True), ("UNMATCHED", 0, True), ("CONFLICT", 3, True)], ["true", "false", "false", "true", "true"], contracts.exact_outcome)


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    schema, rows, want, build = CASES[name]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row int, {schema}")
    got = df.select("row", build(*[F.col(c) for c in df.columns[1:]]).cast("string").alias("got")).orderBy("row").collect()
    assert [r.got for r in got] == want
