"""Provider link plans: the status of a document's match with another provider's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["UNMATCHED", "CREDENTIAL_UNAVAILABLE", "METADATA_INCOMPLETE", "AMBIGUOUS", "CONFLICT", "EXACT"]
MOST = 20


def link_plan(documents: DataFrame, candidates: DataFrame, key: str, compare: list[str], has_credential: bool = True) -> DataFrame:
    """documents (key, compare...) with status and the matched candidate (key, candidate, total, compare...).

    total is the provider's count of hits: beyond 20 nothing is decided. One
    candidate with all compared columns equal is EXACT, one that differs a
    CONFLICT, several equal ones AMBIGUOUS.
    """
    complete = F.lit(True)
    for c in compare:
        complete = complete & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    c = candidates.select(key, "candidate", "total", F.struct(*compare).alias("_theirs"))
    j = documents.withColumn("_ours", F.struct(*compare)).join(c, key, "left")
    equal = F.col("_ours").eqNullSafe(F.col("_theirs"))
    per = j.groupBy(key).agg(
        F.count("candidate").alias("_n"),
        F.max("total").alias("_total"),
        F.count_if(equal).alias("_equal"),
        F.min(F.when(equal, F.col("candidate"))).alias("candidate"),
    )
    status = (
        F.when(F.lit(not has_credential), "CREDENTIAL_UNAVAILABLE")
        .when(~complete, "METADATA_INCOMPLETE")
        .when(F.coalesce("_n", F.lit(0)) == 0, "UNMATCHED")
        .when((F.col("_total") > MOST) | (F.col("_equal") > 1), "AMBIGUOUS")
        .when(F.col("_equal") == 0, F.when(F.col("_n") > 1, "AMBIGUOUS").otherwise("CONFLICT"))
        .otherwise("EXACT")
    )
    out = documents.join(per, key, "left").withColumn("status", status)
    return out.withColumn("candidate", F.when(F.col("status") == "EXACT", F.col("candidate"))).drop("_n", "_total", "_equal")


#: What a rendered document says of its link, by status.
BANNERS = {
    "EXACT": "lawgo 판례 연결 확인 · 조문별 보강 상태와 적용 버전은 각 위치에서 확인",
    "UNMATCHED": "lawgo 대응 판례 미연결",
    "AMBIGUOUS": "lawgo 연결 후보 모호 · 검토 필요",
    "CONFLICT": "lawgo 연결 정보 충돌 · 검토 필요",
    "CREDENTIAL_UNAVAILABLE": "lawgo 취득 설정 미완료 · 보강 대기",
    "METADATA_INCOMPLETE": "lawgo 연결 대조 정보 부족 · 보강 대기",
}
PENDING_BANNER = "lawgo 연결·보강 대기"


def banner(status: Column) -> Column:
    """The line that stands above a rendered document; any other status, or none, is pending."""
    out = F.when(F.lit(False), F.lit(""))
    for name, text in BANNERS.items():
        out = out.when(status == name, text)
    return out.otherwise(PENDING_BANNER)


def reproved(stored: DataFrame, found: DataFrame, keys: list[str], evidence: list[str]) -> DataFrame:
    """Stored links against links found anew: SAME, EVIDENCE_DIFFERS, NOT_FOUND_AGAIN, or NEW where none is stored."""
    a = stored.select(*keys, F.struct(*evidence).alias("_stored"))
    b = found.select(*keys, F.struct(*evidence).alias("_found"))
    state = (
        F.when(F.col("_stored").isNull(), "NEW")
        .when(F.col("_found").isNull(), "NOT_FOUND_AGAIN")
        .when(F.col("_stored") == F.col("_found"), "SAME")
        .otherwise(F.when(F.col("_stored").eqNullSafe(F.col("_found")), "SAME").otherwise("EVIDENCE_DIFFERS"))
    )
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))
