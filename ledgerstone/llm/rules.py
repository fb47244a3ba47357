"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Measures of a text are worked out inside its row, each once; a rule bounds one measure, or its share of another in hundredths. All numbers
are integers, so that a rule reads the same in Spark and in any other SQL, and no bound depends on rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"
WINDOW = 5
# Frequent function words of Latin-script languages, English, German, French, Spanish, Italian, Portuguese, Dutch and Swedish in turn.
STOP_WORDS = tuple(
    dict.fromkeys(
        """the of and to in is that it was for on are with as this be at by from or an have not they
        der die das und ist nicht ein eine zu den von mit sich auf für dem des im als auch es
        le la les de des et un une est que qui dans pour pas sur au plus par il elle
        el los las del y en que un una es se por con para su al lo como más
        il di e che è per non con sono del della le si
        o a os as do da em um uma não com por para
        het een van en dat is niet op te voor met zijn
        och att det som en på är av för med till inte""".split()
    )
)
MARKS = ".,;:!?"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_latin_words", "n_upper_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")
#: What Spark and DuckDB count the same way: a match goes on to the end of its word, so that a word counts once.
COUNTED = {"n_letter_words": rf"\p{{L}}[^{BLANK}]*", "n_latin_words": rf"[A-Za-z][^{BLANK}]*", "n_upper_words": rf"\p{{Lu}}\p{{Lu}}[^{BLANK}]*", "n_symbols": r"[#*$%&|<>]"}
LINES = {"n_bullet_lines": rf"^[{BLANK}]*[*•‣◦-]", "n_ellipsis_lines": rf"(\.\.\.|…)[{BLANK}]*$"}


@dataclass(frozen=True)
class Rule:
    """A text fails if the measure, or a hundred times it over `per`, is under `least` or over `most`. when: a measure or share that has to be so large for the rule to hold."""

    name: str
    measure: str
    per: str | None = None
    least: int | None = None
    most: int | None = None
    when: tuple[tuple[str, str | None, int], ...] = ()

    def sql(self) -> str:
        def sides(measure, per, bound):
            return (f"100 * {measure}", f"{bound} * {per}") if per else (measure, str(bound))

        tests = [" < ".join(sides(self.measure, self.per, self.least))] if self.least is not None else []
        tests += [" > ".join(sides(self.measure, self.per, self.most))] if self.most is not None else []
        return " AND ".join([f"({' OR '.join(tests)})", *(" >= ".join(sides(*w)) for w in self.when)])


LATIN = ("n_latin_words", "n_words", 80)
#: The base, and what the method adds. Bounds on words and stop words hold where texts are written in words of Latin letters.
BASE = (Rule("words", "n_words", least=10), Rule("repeats", "n_repeat_words", "n_words", most=20))
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1500, when=(LATIN,)),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("letters", "n_letter_words", "n_words", least=80),
    Rule("stop_words", "n_stop_words", "n_words", least=1, when=(LATIN, ("n_words", None, 100))),
    Rule("upper", "n_upper_words", "n_words", most=50),
    Rule("dup_lines", "n_dup_lines", "n_lines", most=30, when=(("n_lines", None, 5),)),
    Rule("bullets", "n_bullet_lines", "n_lines", most=90, when=(("n_lines", None, 5),)),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=30, when=(("n_lines", None, 5),)),
)


def window_hashes(hashes: Column, size=WINDOW) -> Column:
    """A hash for each run of so many words. hashes: the words', more than that many."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))


def words_in_repeats(ranked: Column, size=WINDOW) -> Column:
    """How many words are in windows that the text has twice or more. ranked: the text's windows as structs of h (hash) and at, sorted; null: none are.

    A window equal to a neighbour gives its place; in order of place each adds the words that the one before it doesn't cover.
    """
    near = lambda i, k: F.get(ranked, i + k)["h"]
    again = F.filter(ranked, lambda x, i: x["h"].eqNullSafe(near(i, 1)) | x["h"].eqNullSafe(near(i, -1)))
    begin = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("sum"))
    step = lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(size), p - a["last"])).alias("sum"))
    return F.coalesce(F.aggregate(F.sort_array(F.transform(again, lambda x: x["at"])), begin, step, lambda a: a["sum"]), F.lit(0))


def matching(texts: Column, pattern: str) -> Column:
    return F.size(F.filter(texts, lambda x: F.regexp_like(x, F.lit(pattern))))


def measured(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and MEASURES (long), one row a row of docs."""
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    of = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    of = of.select("doc_id", "text", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"), F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD))).alias("lines"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counts = {name: F.regexp_count(text, F.lit(p)) for name, p in COUNTED.items()}
    counts |= {name: matching(lines, p) for name, p in LINES.items()}
    counts |= {
        "n_words": F.size(words),
        "word_chars": F.length(text) - F.regexp_count(text, F.lit(f"[{BLANK}]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_stop_words": F.size(F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(MARKS)).isin(*STOP_WORDS))),
    }
    of = of.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.when(F.size(words) > WINDOW, hashes).alias("hashes"))
    of = of.withColumn("windows", F.when(F.col("hashes").isNotNull(), window_hashes(F.col("hashes")))).drop("hashes")
    some = F.size(F.array_distinct("windows")) < F.size("windows")  # most texts repeat none
    of = of.withColumn("ranked", F.when(some, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("at")))))).drop("windows")
    of = of.withColumn("n_repeat_words", words_in_repeats(F.col("ranked")))
    return of.select("doc_id", *(F.col(m).cast("long").alias(m) for m in MEASURES))


def judged(docs: DataFrame, rules=RULES, base=BASE, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, MEASURES, base_failed, failed (names of the rules failed, in order), kept: one row a row of docs.

    Null and empty texts have no words, so that they fail the base. Repeated rows are judged alike, null ids are kept, no rows give none. Texts are read whole, of
    whatever length; nothing leaves its row, so that no key is hot. Only the id and text columns are read; others, whatever their names, are ignored.
    A rule's bound is met by equality. 64-bit hashes tell a text's windows apart: of a million windows two different ones are taken for one with a chance of 3e-8.
    """
    failed = F.filter(F.array(F.lit(None).cast("string"), *(F.when(F.expr(r.sql()), F.lit(r.name)) for r in (*base, *rules))), lambda x: x.isNotNull())  # of strings, even without rules
    out = measured(docs, id_col, text_col).withColumn("base_failed", F.expr(" OR ".join(f"({r.sql()})" for r in base) or "false")).withColumn("failed", failed)
    return out.withColumn("kept", F.size("failed") == 0)


def clean(docs: DataFrame, rules=RULES, base=BASE, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs that no rule fails, with all their columns. Nulls, repeats and empty tables as in judged()."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("t"))
    found = judged(rows, rules, base, "row", "t").filter("kept")
    return found.select(*(F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns))


def op11_quality(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES[:5], "base_failed", "kept")


_COUNTS = ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {n}" for n, p in COUNTED.items())
_LINES = ", ".join(f"count(*) FILTER (regexp_matches(line, '{p}')) AS {n}" for n, p in LINES.items())
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d),
s AS (SELECT row, count(*) AS n_stop_words FROM w WHERE rtrim(lower(word), '{MARKS}') IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}) GROUP BY row),
v AS (SELECT row, unnest(range(1, len(words) - {WINDOW - 2})) AS place, unnest(list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' '))) AS g FROM d WHERE len(words) > {WINDOW}),
g AS (SELECT row, place, count(*) OVER (PARTITION BY row, g) AS times FROM v),
r AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest(range(place, place + {WINDOW})) AS p FROM g WHERE times > 1) GROUP BY row),
l AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, {_LINES} FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY row),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, {_COUNTS},
        {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in ("n_lines", "n_dup_lines", *LINES, "n_stop_words", "n_repeat_words"))}
      FROM d LEFT JOIN s USING (row) LEFT JOIN r USING (row) LEFT JOIN l USING (row))
SELECT doc_id, {", ".join(MEASURES[:5])}, ({" OR ".join(f"({r.sql()})" for r in BASE)}) AS base_failed, NOT ({" OR ".join(f"({r.sql()})" for r in (*BASE, *RULES))}) AS kept FROM m"""
