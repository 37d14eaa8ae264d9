"""Validation contracts as arrays of reasons: checks never raise inside a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import slice_of
from ..functions.urls import is_safe

DIGEST = "^[0-9a-f]{64}$"


def reasons(**rules: Column) -> Column:
    """Names of the rules that a row breaks, in order; a rule is a test that must hold, null failing it."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))


def not_blank(x: Column) -> Column:
    return F.coalesce(~x.rlike(r"(?U)^\s*$"), F.lit(False))


def digest(x: Column) -> Column:
    return x.rlike(DIGEST)


def count_value(x: Column) -> Column:
    return x >= 0


def revision_value(x: Column) -> Column:
    return x >= 1


def day_text(x: Column) -> Column:
    return x.rlike(r"^\d{4}-\d{2}-\d{2}$") & parse_date(x).isNotNull()


def safe_url(x: Column) -> Column:
    return is_safe(x)


def score(x: Column) -> Column:
    return x.between(0.0, 1.0) & ~F.isnan(x)


def span_holds(text: Column, start: Column, end: Column, piece: Column) -> Column:
    """0 <= start < end, and the text has exactly the piece there."""
    return (start >= 0) & (end > start) & (end <= F.length(text)) & (slice_of(text, start, end) == piece)


def acquired_iff(state: Column, artifact: Column, failure: Column) -> Column:
    """ACQUIRED with an artifact only; FAILED with a failure only; else neither."""
    return (
        F.when(state == "ACQUIRED", artifact.isNotNull() & failure.isNull())
        .when(state == "FAILED", artifact.isNull() & failure.isNotNull())
        .otherwise(artifact.isNull() & failure.isNull())
    )


def exact_outcome(status: Column, candidates: Column, complete: Column) -> Column:
    """EXACT needs one candidate and complete metadata; AMBIGUOUS several; UNMATCHED none."""
    return (
        F.when(status == "EXACT", (candidates == 1) & complete)
        .when(status == "AMBIGUOUS", candidates > 1)
        .when(status == "UNMATCHED", candidates == 0)
        .otherwise(F.lit(True))
    )


def field_contract(status: Column, value: Column, evidence: Column, allowed: list[str]) -> Column:
    return reasons(unknown_status=status.isin(allowed), present_without_value=(status != "PRESENT") | value.isNotNull(), present_without_evidence=(status != "PRESENT") | evidence.isNotNull())


#: Checks that gold needs.
GOLD_CHECKS = ["schema", "alignment", "evidence", "provenance", "duplicate", "identity", "fidelity"]


def artifact(artifact_id: Column, parent: Column, storage_key: Column, representation: Column) -> Column:
    """Relative storage keys without steps up; no artifact is its own parent; derived ones have a parent."""
    bad_key = storage_key.rlike(r"^/|(^|/)\.\.(/|$)|[\\:]")
    return reasons(
        INVALID_STORAGE_KEY=~bad_key,
        SELF_PARENT_ARTIFACT=parent.isNull() | (parent != artifact_id),
        MISSING_PARENT_ARTIFACT=(representation == "RESPONSE_BYTES") | parent.isNotNull(),
    )


def block(block_id: Column, parent_block: Column, parent_artifact: Column, span_artifact: Column, kind: Column, asset: Column) -> Column:
    return reasons(
        SELF_PARENT_BLOCK=parent_block.isNull() | (parent_block != block_id),
        BLOCK_ARTIFACT_MISMATCH=span_artifact.isNull() | (span_artifact == parent_artifact),
        MISSING_ASSET_REFERENCE=~kind.isin("image", "page_image") | asset.isNotNull(),
    )


def fidelity(tier: Column, visual: Column, count: Column, detection: Column, scope: Column, needs_ocr: Column, ocr: Column) -> Column:
    """Three-valued observations: what wasn't looked for isn't absent."""
    looked = visual.isNotNull() | count.isNotNull() | (detection != "UNKNOWN")
    return reasons(
        MISSING_DETECTION_SCOPE=~looked | scope.isNotNull(),
        CONFLICTING_VISUAL_COUNT=count.isNull() | visual.eqNullSafe(count > 0),
        INCOMPLETE_NEGATIVE_DETECTION=visual.isNull() | visual | (detection == "COMPLETE"),
        SCAN_REQUIRES_OCR=(tier != "SCAN") | needs_ocr.eqNullSafe(F.lit(True)),
        CONFLICTING_OCR_STATUS=~needs_ocr.eqNullSafe(F.lit(True)) | (ocr != "NOT_REQUIRED"),
    )


def gold(status: Column, passed: Column, blockers: Column) -> Column:
    """ELIGIBLE needs every check and no blocker; INELIGIBLE needs a blocker."""
    whole = F.size(F.array_except(F.array(*[F.lit(c) for c in GOLD_CHECKS]), passed)) == 0
    return reasons(
        INCOMPLETE_GOLD_ASSESSMENT=(status != "ELIGIBLE") | (whole & (F.size(blockers) == 0)),
        MISSING_GOLD_BLOCKER=(status != "INELIGIBLE") | (F.size(blockers) > 0),
    )


def inventory(completeness: Column, entries: Column, total: Column, observed: Column, basis: Column, failed_pages: Column, started: Column, finished: Column, retrieved: Column) -> Column:
    """Header rules of a snapshot; COMPLETE needs a basis, no failed page and the full count."""
    full = completeness == "COMPLETE"
    return reasons(
        INVENTORY_COUNT_MISMATCH=observed == entries,
        INVALID_INVENTORY_TIMES=(started <= finished) & (retrieved >= finished),
        UNPROVEN_COMPLETE_INVENTORY=~full | ((failed_pages == 0) & basis.isNotNull()),
        INCOMPLETE_INVENTORY_COUNT=~full | total.isNull() | (total == entries),
    )


def legacy_record(preservation_id: Column, snapshot: Column, position: Column, source_ids: Column, body: Column, body_state: Column) -> Column:
    """A preserved row is named by snapshot and position, repeats no source id and says truly whether it has a body."""
    return reasons(
        LEGACY_PRESERVATION_ID_MISMATCH=preservation_id == F.concat(F.lit("legacy-row:"), snapshot, F.lit(":"), position.cast("string")),
        DUPLICATE_SOURCE_KEY=F.size(F.array_distinct(source_ids)) == F.size(source_ids),
        LEGACY_BODY_STATE_MISMATCH=(F.coalesce(body, F.lit("")) != "") == (body_state == "PRESERVED"),
    )


def evidence(text: Column, start: Column, end: Column, quote: Column, version_known: Column) -> Column:
    """Evidence of an issue: the source is loaded, of a known version, and has the quote at the place."""
    return reasons(EVIDENCE_SOURCE_NOT_LOADED=text.isNotNull(), EVIDENCE_SOURCE_VERSION_MISMATCH=version_known, TEXT_SPAN_MISMATCH=text.isNull() | span_holds(text, start, end, quote))


def decision_key(court: Column, case_number: Column, kind: Column) -> Column:
    """A key's spelling: unpadded court, a full docket, a known kind."""
    from ..functions.keys import DOCKET, KINDS
    from ..functions.text import strip

    return reasons(COURT_SPELLING=(court == strip(court)) & (court != ""), CASE_NUMBER_SPELLING=case_number.rlike(DOCKET), UNKNOWN_KIND=kind.isin(sorted(set(KINDS.values()))))


def batch_input(position: Column, times: Column, size: Column, most: int, sha256: Column, real: Column) -> Column:
    """A row of a batch's input: a position that occurs once, a size within the limit, the hash that was promised."""
    return reasons(INVALID_POSITION=position >= 0, DUPLICATE_POSITION=times == 1, EMPTY_INPUT=size > 0, INPUT_SIZE_LIMIT=size <= most, INPUT_HASH_MISMATCH=real == sha256)


def stored_cell(kind, x: Column) -> Column:
    """Whether a cell comes back from its tagged form as it was."""
    from ..functions.cells import tag, text_of, untag

    return untag(tag(kind, x)).eqNullSafe(text_of(kind, x))
