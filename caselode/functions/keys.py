"""Entity keys: docket aliases, decision kinds, business keys. Nothing is guessed: what can't be read gives no key."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, strip

#: Observed spellings of decision kinds and the kind of each.
KINDS = {
    "판결": "판결",
    "전원합의체판결": "판결",
    "결정": "결정",
    "전원합의체결정": "결정",
    "중간판결": "중간판결",
    "명령": "명령",
    "재결": "재결",
}
DOCKET = "^([0-9]{2,4}[가-힣]+)([0-9]+)$"
_DISPOSITION = r"(중간판결|판결|결정|명령)\s*[★☆]*\s*$"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def decision_kind(raw: Column) -> Column:
    """The kind of an observed spelling, exactly; else null."""
    return F.try_element_at(literal_map(KINDS), strip(raw))


def court_key(raw: Column) -> Column:
    """For comparison only: the name without white space."""
    return compact(F.coalesce(raw, F.lit("")))


def docket_aliases(raw: Column) -> Column:
    """Full dockets of a comma list whose later parts may be bare numbers; empty if any part fails or repeats.

    A fold over the parts carries the prefix of the last full docket.
    """
    state = F.struct(F.lit("").alias("prefix"), F.expr("cast(array() as array<string>)").alias("out"), F.lit(True).alias("ok"))

    def step(a: Column, part: Column) -> Column:
        part = strip(part)
        full = part.rlike(DOCKET)
        number = part.rlike("^[0-9]+$") & (a["prefix"] != "")
        alias = F.when(full, part).otherwise(F.concat(a["prefix"], part))
        ok = a["ok"] & (full | number) & ~F.array_contains(a["out"], alias)
        return F.struct(
            F.when(full, F.regexp_extract(part, DOCKET, 1)).otherwise(a["prefix"]).alias("prefix"),
            F.when(ok, F.array_append(a["out"], alias)).otherwise(a["out"]).alias("out"),
            ok.alias("ok"),
        )

    none = F.expr("cast(array() as array<string>)")
    return F.when(raw.isNull(), none).otherwise(F.aggregate(F.split(raw, ","), state, step, lambda a: F.when(a["ok"], a["out"]).otherwise(none)))


def docket_symbol(raw: Column) -> Column:
    """The letters of the first docket in a text."""
    found = F.regexp_extract(raw, "[0-9]{2,4}[가-힣]+[0-9]+", 0)
    return F.when(found != "", F.regexp_replace(found, "[0-9]", ""))


def disposition(citation: Column) -> Column:
    found = F.regexp_extract(citation, _DISPOSITION, 1)
    return F.when(found != "", found)


def decision_keys(court: Column, dockets: Column, kind: Column) -> Column:
    """array<struct<court, case_number, kind>>: none unless court, every docket and the kind are known."""
    known = (court == strip(court)) & (court != "") & decision_kind(kind).isNotNull()
    keys = F.transform(docket_aliases(dockets), lambda a: F.struct(court.alias("court"), a.alias("case_number"), decision_kind(kind).alias("kind")))
    return F.when(known, keys).otherwise(F.slice(keys, 1, 0))


def symbol_class(symbol: Column, day: Column, table: dict[str, tuple[str, str | None]]) -> Column:
    """struct<class, status> by a table symbol -> (class, first day on which it is sure).

    Before that day, or without one, the class stands under REVIEW.
    """
    label = F.try_element_at(literal_map({k: v[0] for k, v in table.items()}), symbol)
    since = F.try_element_at(literal_map({k: v[1] or "0001-01-01" for k, v in table.items()}), symbol).cast("date")
    sure = F.coalesce(day >= since, F.lit(False))
    return F.struct(label.alias("class"), F.when(label.isNull() | ~sure, "REVIEW").otherwise("PRESENT").alias("status"))


def source_id_state(x: Column) -> Column:
    """VALID, PADDED, SENTINEL or NULL; ids are never repaired."""
    return F.when(x.isNull(), "NULL").when(x != strip(x), "PADDED").when(F.lower(x).isin("", "0", "empty"), "SENTINEL").otherwise("VALID")


def positive_int(x: Column) -> Column:
    """An id written [1-9][0-9]*, as a number; else null."""
    return F.when(x.rlike("^[1-9][0-9]*$"), x.try_cast("bigint"))


def count_of(x: Column) -> Column:
    """A count written [0-9]+, as a number; else null."""
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint"))


def exact_metadata(ours: dict[str, Column], theirs: dict[str, Column]) -> Column:
    """Whether court, dockets (as sets), kind and day of two sources are all known and equal."""
    dockets = lambda m: F.array_sort(docket_aliases(m["dockets"]))
    day = lambda m: F.regexp_replace(m["day"], "[^0-9]", "")
    same = (court_key(ours["court"]) == court_key(theirs["court"])) & (court_key(ours["court"]) != "")
    same &= (F.size(dockets(ours)) > 0) & (dockets(ours) == dockets(theirs))
    same &= decision_kind(ours["kind"]) == decision_kind(theirs["kind"])
    same &= (F.length(day(ours)) == 8) & (day(ours) == day(theirs))
    return F.coalesce(same, F.lit(False))


def display_court(x: Column, aliases: dict[str, str]) -> Column:
    """A court's short name by a table of names without white space; else the name as it is."""
    return F.coalesce(F.try_element_at(literal_map(aliases), compact(x)), x)


def id_text(x: Column) -> Column:
    """A numeric id as text, without the fraction of whole numbers."""
    whole = x.cast("bigint")
    return F.when(whole == x, whole.cast("string")).otherwise(x.cast("string"))


def blob_key_state(key: Column) -> Column:
    """VALID if a key is blobs/<first two digits>/<sha256 in lower case>, else INVALID_STORAGE_KEY.

    Keys are made from digests, never from names or URLs, so no key leads out of the store.
    """
    formed = key.rlike("^blobs/[0-9a-f]{2}/[0-9a-f]{64}$") & (F.substring(key, 7, 2) == F.substring(key, 10, 2))
    return F.when(F.coalesce(formed, F.lit(False)), "VALID").otherwise("INVALID_STORAGE_KEY")


def decision_outcome(court: Column, disposition: Column, dockets: Column, case_keys: Column) -> Column:
    """struct<state, keys> of a decision: its keys (court, case_number, kind), sorted, from its declared case keys.

    court and dockets (an array) are the metadata's, null if unknown; case_keys
    is array<struct<court, case_number>>. The first key that cannot stand says
    why: CONFLICTING_DECISION_COURT, or UNREADABLE_KEY; then UNREADABLE_DOCKET
    and CONFLICTING_DECISION_DOCKETS if the metadata's dockets are others.
    Without a known kind there are no keys (UNKNOWN_KIND); else KEYS.
    """
    kind, none = decision_kind(disposition), F.expr("cast(array() as array<string>)")
    own = F.coalesce(case_keys, F.expr("cast(array() as array<struct<court:string,case_number:string>>)"))
    unreadable = lambda x: F.size(docket_aliases(x)) == 0
    faults = F.array_compact(
        F.transform(own, lambda k: F.when(court.isNotNull() & (court != k["court"]), "CONFLICTING_DECISION_COURT").when(unreadable(k["case_number"]) | (k["court"] != strip(k["court"])), "UNREADABLE_KEY"))
    )
    keys = F.flatten(F.transform(own, lambda k: F.transform(docket_aliases(k["case_number"]), lambda a: F.struct(k["court"].alias("court"), a.alias("case_number"), kind.alias("kind")))))
    keys = F.array_sort(F.array_distinct(keys))
    said = F.coalesce(dockets, none)
    named = F.array_sort(F.array_distinct(F.flatten(F.transform(said, docket_aliases))))
    state = (
        F.when(kind.isNull(), "UNKNOWN_KIND")
        .when(F.size(faults) > 0, F.get(faults, F.lit(0)))
        .when(F.exists(said, unreadable), "UNREADABLE_DOCKET")
        .when((F.size(said) > 0) & (named != F.array_sort(F.array_distinct(F.transform(keys, lambda k: k["case_number"])))), "CONFLICTING_DECISION_DOCKETS")
        .otherwise("KEYS")
    )
    return F.struct(state.alias("state"), F.when(state == "KEYS", keys).otherwise(F.slice(keys, 1, 0)).alias("keys"))
