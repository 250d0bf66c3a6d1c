"""Line-first quality rules, in DataFrame functions only.

Every line is held against the line rules: it should end like a sentence (by
the marks of its script; scripts without marks are excepted), not be a row of
navigation, not be boilerplate (a list of phrases in four languages: in others
no line is boilerplate) and not be clutter. Failing lines are
removed, and a document that loses too much of its text that way is rejected,
besides those that the base counts reject.

Results by case: a null text counts as one without words; a text without words
is base_failed and not kept; repeated rows and ties each give their own row; an
empty table gives an empty one; other columns of the input are carried only
where ``keep`` names them, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACE, WORD, materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Shares in percent.
MAX_REPEATED = 50
MAX_LOST = 50
#: ASCII marks that end a sentence or clause, other marks of
#: Unicode's class Po that end none (commas, bullets, references, quotes), what
#: may close after a mark, and the blocks of scripts written without any mark
#: (Thai and Lao; Tai Le and New Tai Lue; Tai Viet).
ASCII_MARKS = ".!?:;"
NO_MARKS = "،、，､﹐﹑՝՚·•‣‧※†‡‰‱′″‴‵‶‷¿¡§¶＠＃％＆＊／＼"
CLOSERS = "'\"”’»›)\\]」』）】》"
UNMARKED = "\u0E00-\u0EFF\u1950-\u19DF\uAA80-\uAADF"
#: A line ends like a sentence where its last characters match: a mark of class
#: Po in any script, or a letter of a script that has none.
TERMINAL = rf"([{ASCII_MARKS}]|[^\P{{Po}}\x00-\x7F{NO_MARKS}]|[{UNMARKED}])[{CLOSERS}]*[\x20\x09-\x0D]*$"
#: Marks between the entries of a navigation row.
NAVIGATION = r"(^|[\x20\x09-\x0D])[|>»›•·/]($|[\x20\x09-\x0D])"
#: In English, German, French and Spanish.
BOILERPLATE = (
    r"(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign (in|up)|log ?in|subscribe (now|to)|enable javascript|skip to (main )?content|share (on|this)|read more"
    r"|datenschutzerkl.rung|nutzungsbedingungen|alle rechte vorbehalten|hier klicken|jetzt anmelden|newsletter abonnieren|weiterlesen|zum inhalt springen"
    r"|politique de confidentialit|conditions d.utilisation|tous droits r.serv|cliquez ici|se connecter|lire la suite|aller au contenu"
    r"|pol.tica de privacidad|t.rminos de uso|todos los derechos reservados|haga clic aqu|iniciar sesi|leer m.s|ir al contenido)"
)
BOILERPLATE_WORDS = 12
#: More words than that.
LONG = rf"(?:[^{SPACE}]++[{SPACE}]++){{{BOILERPLATE_WORDS}}}[^{SPACE}]"
CLUTTER = r"[!#*$%&|<>]{2,}"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def has_word(text: Column) -> Column:
    return text.rlike(WORD)


def _line_fails(line: Column) -> Column:
    """Cheap tests stand first; words are only counted where marks were
    found."""
    n = F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(NAVIGATION))
    clutter = F.regexp_count(line, F.lit(CLUTTER))
    navigation = (marks >= 2) & (5 * marks >= n)
    cluttered = line.rlike(CLUTTER) & (5 * clutter >= n)
    return ~line.rlike(TERMINAL) | navigation | cluttered | (~line.rlike(LONG) & line.rlike(BOILERPLATE))


def quality(df: DataFrame, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and the text that the line rules leave
    as clean_text."""
    held = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    held = held.withColumn("_w", words(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n", -1), has_word))
    w = F.col("_w")
    heads = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    # Equal windows have equal hashes, so only a text with a hash twice has its
    # windows written out and sorted.
    held = held.withColumn("_hashes", F.transform(heads, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    grams = F.transform(heads, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    held = held.withColumn("_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(grams)))
    p = F.col("_pairs")
    twice = F.filter(p, lambda x, k: (F.coalesce(F.get(p, k - 1)["g"] == x["g"], F.lit(False))) | F.coalesce(F.get(p, k + 1)["g"] == x["g"], F.lit(False)))
    held = held.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("_at")
    reach = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
    held = held.withColumn("_clean", F.filter("_lines", lambda x: ~_line_fails(x)))
    joined = F.concat_ws("", w)
    total, left = F.length(F.concat_ws("", "_lines")), F.length(F.concat_ws("", "_clean"))
    held = held.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        (100 * (total - left) > MAX_LOST * total).alias("_lost"),
        F.array_join("_clean", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return held.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("_lost")).drop("_lost")


def cleaned(df: DataFrame, text: str = "text", size: str | None = None) -> DataFrame:
    """The rows of kept documents with the line rules applied to their text
    (and ``size``, if named, its new number of characters). All columns stay,
    whatever their names."""
    others = [c for c in df.columns if c != text]
    row = F.struct(F.lit(True).alias("any"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    rows = df.select(row.alias("_row"), F.col(text).alias("_source"))
    # Written before they are filtered: the optimizer would otherwise move the
    # filter below the columns it is made from, and make each many times over.
    # Of a rejected document only the verdict is written, and no text twice.
    judged = materialize(quality(rows, "_source", ["_row"]).select("kept", *(F.when(F.col("kept"), F.col(c)).alias(c) for c in ("_row", "clean_text"))), "judged")
    own = {c: F.col("_row")[f"c{i}"] for i, c in enumerate(others)} | {text: F.col("clean_text")}
    if size:
        own[size] = F.length("clean_text").cast(df.schema[size].dataType)
    return judged.where("kept").select(*(own[c].alias(c) for c in df.columns))


#: The same in DuckDB's SQL.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM c) GROUP BY doc_id),
l AS (SELECT doc_id, x, len(regexp_extract_all(x, '{WORD}')) AS n,
      len(regexp_extract_all(x, '{NAVIGATION}')) AS marks, len(regexp_extract_all(x, '{CLUTTER}')) AS clutter
      FROM (SELECT doc_id, unnest(lines) AS x FROM w)),
s AS (SELECT doc_id, sum(length(x)) AS total,
      coalesce(sum(length(x)) FILTER (WHERE NOT (NOT regexp_matches(x, '{TERMINAL.replace("'", "''")}') OR (marks >= 2 AND 5 * marks >= n)
        OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(x, '{BOILERPLATE}')) OR 5 * clutter >= n)), 0) AS kept_chars
      FROM l GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
      length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      100 * (coalesce(total, 0) - coalesce(kept_chars, 0)) > {MAX_LOST} * coalesce(total, 0) AS lost
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND NOT lost AS kept
FROM f
"""
