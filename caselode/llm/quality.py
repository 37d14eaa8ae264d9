"""Quality rules: a table of thresholds compiled into one projection.

Each rule names a ratio or count of a text and the range that a good text has.
`quality_rules` compiles the table into Column expressions of a single
select: no user functions, no shuffle, no join.

The stop-word rule judges a text by the function words of its own language, so
it applies only where a language column is given and names a language of
STOP_WORDS; texts of all other languages are judged by the other rules.

Defined cases: a null text counts as empty (0 words, base_failed); repeated
rows are judged each on its own; input columns of the same names as outputs
are replaced; any other column passes through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, unused, words_of

WINDOW = 8

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the be to of and that have with in is it for was on are as at this by not or an",
    "de": "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es",
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur avec",
    "es": "de la que el en y los del se las por un para con no una su al lo como",
}

SYMBOLS = "#*$%&|<>"
#: A word that holds this is a word of letters (beyond ASCII everything counts).
LETTER = r"[A-Za-z\x{0080}-\x{10FFFF}]"

#: name, metric, lowest, highest (null: no bound). Ratios are of words or of
#: lines that hold a word.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "mean_word_chars", 1.5, 15.0),  # words of one or two characters are common in some scripts
    ("symbol_ratio", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_ratio", 0.02, None),
    ("letter_words", "letter_word_ratio", 0.6, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.3),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines"]
BASE_MIN_WORDS = 20
BASE_MAX_REPEAT_PERCENT = 30


def _without(text: Column, chars: str) -> Column:
    for ch in chars:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def repeat_words(words: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more in the text.

    Windows are compared by a 64-bit hash. Only texts that do repeat a window
    sort their hashes; time is n log n in the words of one text.
    """

    def windows(wh: Column) -> Column:
        last = F.size(wh) - WINDOW
        one = lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.expr("cast(array() as array<bigint>)"))

    def repeated(t: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(t, j)["x"] == e["x"], F.lit(False))
        return F.sort_array(F.transform(F.filter(t, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        widths = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(widths, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        places = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(places, repeated), covered)).otherwise(F.lit(0).cast("bigint"))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def _stop_words(words: Column, lang: Column | None) -> Column:
    """Words of the text that are function words of its language; null for a language without a list."""
    if lang is None:
        return F.lit(None)

    def of(name: str) -> Column:
        own = sorted(STOP_WORDS[name].split())
        return F.size(F.filter(words, lambda w: F.lower(w).isin(own)))

    out = F.when(F.lit(False), F.lit(0))
    for name in STOP_WORDS:
        out = out.when(lang == name, of(name))
    return out


def _counts(text: Column, lang: Column | None) -> Column:
    parts = F.struct(words_of(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.rtrim(_blanks(x)) != "").alias("l"))

    def counted(p: Column) -> Column:
        words, lines = p["w"], p["l"]
        ends = lambda x: F.rtrim(_blanks(x)).endswith("...") | F.rtrim(_blanks(x)).endswith("…")
        out = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeat_words(words),
            "n_lines": F.size(lines),
            "n_stop_words": _stop_words(words, lang),
            "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(LETTER))),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(_blanks(x)).substr(1, 1).isin("-", "*", "•"))),
            "n_ellipsis_lines": F.size(F.filter(lines, ends)),
        }
        return F.struct(*[v.cast("bigint").alias(k) for k, v in out.items()])

    return let(parts, counted)


def verdict(text: Column, lang: Column | None = None, rules=RULES) -> Column:
    """struct of the counts, `base_failed`, `failed` (names of failed rules) and `kept` of a text.

    n_stop_words is null, and its rule not applied, where lang has no list of STOP_WORDS.
    """

    def judged(c: Column) -> Column:
        per = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).when(c[a].isNotNull(), F.lit(0.0))
        metrics = {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbols_per_word": per("n_symbols", "n_words"),
            "stop_ratio": per("n_stop_words", "n_words"),
            "letter_word_ratio": per("n_letter_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "bullet_line_ratio": per("n_bullet_lines", "n_lines"),
            "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        }
        failed = []
        for name, metric, low, high in rules:
            bad = F.lit(False)
            if low is not None:
                bad = bad | (metrics[metric] < low)
            if high is not None:
                bad = bad | (metrics[metric] > high)
            failed.append(F.when(bad, F.lit(name)))
        base = (c["n_words"] < BASE_MIN_WORDS) | (100 * c["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * c["n_words"])
        names = F.array_compact(F.array(*failed)) if failed else F.expr("cast(array() as array<string>)")
        return F.struct(*[c[k].alias(k) for k in COUNTS], base.alias("base_failed"), names.alias("failed"), (~base & (F.size(names) == 0)).alias("kept"))

    return let(let(F.coalesce(text, F.lit("")), lambda t: _counts(t, lang)), judged)


def quality_rules(df: DataFrame, text: str = "text", lang: str | None = "lang", rules=RULES) -> DataFrame:
    """df with the fields of `verdict` as columns; lang: the column of declared languages, if there is one."""
    (q,) = unused(df, "quality")
    out = df.withColumn(q, verdict(F.col(text), F.col(lang) if lang else None, rules))
    names = [*COUNTS, "base_failed", "failed", "kept"]
    return out.select(*[c for c in df.columns if c not in names], *[F.col(q)[n].alias(n) for n in names])


#: Scripts that are written without blanks between words, and characters that stand for a word there.
UNSEGMENTED = "[" + "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")) + "]"
WORD_CHARS = 2


def kept_by_script(text: Column, lang: Column | None = None) -> Column:
    """Whether a text is kept, where its declared language or the word rule may not fit its script.

    A text that fails nothing but the stop words of its declared language stays
    if most of its letters are of another script than those lists are in. A
    text with too few words, most of whose letters are of a script without
    blanks, is judged as if a blank followed every WORD_CHARS of them.
    """
    letters = lambda t, kind: F.length(F.regexp_replace(t, f"[^{kind}]", ""))
    text = F.coalesce(text, F.lit(""))
    foreign = 2 * letters(text, r"\p{IsLatin}") < letters(text, r"\p{L}")
    unsegmented = 2 * letters(text, UNSEGMENTED[1:-1]) > letters(text, r"\p{L}\p{M}")
    cut = F.regexp_replace(text, f"({UNSEGMENTED}{{{WORD_CHARS}}})", "$1 ")
    alone = lambda v: (F.size(v["failed"]) == 1) & F.array_contains(v["failed"], "stop_words") & ~v["base_failed"]
    again = lambda v: F.when(v["kept"], F.lit(True)).when(alone(v), foreign).when((v["n_words"] < BASE_MIN_WORDS) & unsegmented, verdict(cut)["kept"]).otherwise(F.lit(False))
    return let(verdict(text, lang), again)


def _blanks(x: Column) -> Column:
    return F.translate(x, "\t\x0b\x0c\r", "    ")


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs).select("doc_id", *OUT)


def quality_sql() -> str:
    stops = " ".join("WHEN '{}' THEN len(list_filter(w, lambda x: lower(x) IN ({})))".format(k, ", ".join(f"'{w}'" for w in ws.split())) for k, ws in STOP_WORDS.items())
    metric = {
        "mean_word_chars": "word_chars / n_words",
        "symbols_per_word": "n_symbols / n_words",
        "stop_ratio": "n_stop / n_words",
        "letter_word_ratio": "n_letter / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines",
        "bullet_line_ratio": "n_bullet / n_lines",
        "ellipsis_line_ratio": "n_ellipsis / n_lines",
    }
    bad = []
    for _, m, low, high in RULES:
        value = f"coalesce({metric[m].replace(' / ', '::double / nullif(')}, 0), CASE WHEN {metric[m].split()[0]} IS NOT NULL THEN 0 END)"
        if low is not None:
            bad.append(f"coalesce({value} < {low}, false)")
        if high is not None:
            bad.append(f"coalesce({value} > {high}, false)")
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: trim(translate(x, chr(9)||chr(11)||chr(12)||chr(13), '    ')) <> '') AS l FROM d),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
      CASE lang {stops} END AS n_stop,
      len(list_filter(w, lambda x: regexp_matches(x, '{LETTER}'))) AS n_letter,
      len(list_filter(l, lambda x: substr(ltrim(translate(x, chr(9)||chr(11)||chr(12)||chr(13), '    ')), 1, 1) IN ('-', '*', '•'))) AS n_bullet,
      len(list_filter(l, lambda x: rtrim(translate(x, chr(9)||chr(11)||chr(12)||chr(13), '    ')) SIMILAR TO '(.|\\s)*(\\.\\.\\.|…)')) AS n_ellipsis FROM a),
win AS (SELECT doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], chr(10)) AS g FROM a, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS s(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nx - i, {WINDOW})))::BIGINT AS r
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id),
b AS (SELECT m.*, coalesce(r, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
c AS (SELECT *, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({' OR '.join(bad)}) AS kept FROM c
"""
