"""Line-first quality rules in DataFrame functions only: failing lines go, then documents that lose too much of their text.

Everything is one projection over a row: no shuffle, no Python. `let` binds a value that is used more than once inside
higher-order functions, so that Catalyst can't inline and repeat it for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, unused

#: The blank characters themselves, to trim.
BLANKS = " \t\n\x0b\f\r"
#: Marks that end a sentence in any script, and what may close after them.
MARKS, CLOSING = ".!?…。！？｡؟۔।॥።፧։။។།", r"\x22'”’»)\]」』）】"
#: A line must end like this; Thai and Lao write no mark, so a letter may end theirs. SQL has other names of scripts.
ENDING = rf"[{MARKS}\p{{IsThai}}\p{{IsLao}}][{CLOSING}]*\z"
#: Longer lines, paragraphs whose last mark is missing, pass with the end of a sentence inside.
INNER, LEAST_LONG = rf"[{MARKS}][{CLOSING}]*[ \t]", 120
#: A letter that is not shouted: in lower case, or of a script without case (the ordinal signs of Spanish aside).
QUIET = r"[\p{Ll}[\p{Lo}&&[^ªº]]]"
#: Signs between the entries of menus, and ornaments.
NAVIGATION, ORNAMENT = "|›»·•", "#*$%&|<>"
#: Phrases of page furniture in English, German, French and Spanish: the default of a parameter. Furniture in other words
#: or languages is met by the other rules or missed.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "enable javascript", "skip to content", "subscribe to our newsletter", "lorem ipsum",
    "alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "aller au contenu",
    "todos los derechos reservados", "política de cookies", "política de privacidad", "condiciones de uso", "saltar al contenido",
)
#: Characters of a line for each such sign that it may have; pairs of exclamation marks; length from which a line needs a
#: lower-case letter or one of a script without case.
CHARS_A_SIGN, MOST_SHOUTS, LEAST_SHOUT = 40, 2, 12
#: Share of the characters that a document may lose to failing and repeated lines.
MOST_LOST = 0.4
#: Fewest words, and largest percentage of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_blanks(text: Column) -> Column:
    """`text` with spaces for the other blank characters."""
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def word_list(text: Column) -> Column:
    """Words between the six blank characters; empty for an empty text."""
    return F.array_remove(F.split(plain_blanks(text), " "), "")


def signs(text: Column, kinds: str) -> Column:
    """How many characters of `text` are among `kinds`."""
    return F.length(F.regexp_replace(text, f"[^{kinds}]+", ""))


def is_blank(line: Column) -> Column:
    return F.trim(plain_blanks(line)) == ""


def furniture(text: Column, phrases: tuple[str, ...]) -> Column:
    """True if the text holds a phrase of page furniture."""

    def holds(low: Column) -> Column:
        found = F.lit(False)
        for x in phrases:
            found = found | low.contains(x)
        return found

    return let(F.lower(text), holds)


def clean_line(line: Column, furnished: Column, phrases: tuple[str, ...]) -> Column:
    """True for a line with a word that passes every rule. furnished: whether any line of the text holds a phrase."""
    return (
        (F.right(F.rtrim(plain_blanks(line)), F.lit(4)).rlike(ENDING) | ((F.length(line) >= LEAST_LONG) & line.rlike(INNER)))
        & (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit(""))) <= 2 * MOST_SHOUTS)
        & (signs(line, NAVIGATION + ORNAMENT) * CHARS_A_SIGN <= F.length(line))
        & ((F.length(line) < LEAST_SHOUT) | line.rlike(QUIET))
        & ~(furnished & furniture(line, phrases))
    )


def first_lines(lines: Column) -> Column:
    """Lines (x, blank) without those that were there before, in their order; blank ones all stay.

    Equal lines lie side by side once they are sorted by hash, so a text of many lines costs no square of them.
    """
    placed = F.array_sort(F.transform(lines, lambda s, i: F.struct(F.xxhash64(s["x"]).alias("h"), s["x"].alias("x"), i.alias("i"), s["blank"].alias("blank"))))

    def firsts(p: Column) -> Column:
        new = F.filter(p, lambda s, j: s["blank"] | (j == 0) | ~F.get(p, j - 1)["x"].eqNullSafe(s["x"]))
        back = F.array_sort(F.transform(new, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"), s["blank"].alias("blank"))))
        return F.transform(back, lambda s: F.struct(s["x"].alias("x"), s["blank"].alias("blank")))

    return let(placed, firsts)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the text holds twice or more, the first included.

    Windows are sorted by a 64-bit hash; neighbours count only if their words are the same.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def same(x: Column, y: Column) -> Column:
        equal = y["h"].eqNullSafe(x["h"])
        for o in range(3):
            equal = equal & (F.get(words, x["i"] + o) == F.get(words, y["i"] + o))
        return equal

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def of_hashes(h: Column) -> Column:
        spots = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(spots, covered))

    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, of_hashes))


def judged(docs: DataFrame, text: Column, phrases: tuple[str, ...]) -> tuple[DataFrame, str]:
    """`docs` with a struct of all measures, the verdict and the cleaned text, and the name of that column."""
    of, on, name = unused(docs.columns, "of_words", "of_lines", "judged")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    total = lambda a: F.length(F.array_join(a, ""))
    full_of = lambda rows: F.transform(F.filter(rows, lambda s: ~s["blank"]), lambda s: s["x"])

    def of_lines(rows: Column, furnished: Column) -> Column:
        """rows: all lines of a text as (x, blank)."""

        def of_full(full: Column) -> Column:
            def of_once(n_once: Column) -> Column:
                once = F.when(n_once == F.size(full), rows).otherwise(first_lines(rows))
                passed = F.filter(once, lambda s: s["blank"] | clean_line(s["x"], furnished, phrases))
                return let(
                    passed,
                    lambda p: F.struct((F.size(full) - n_once).alias("n_dup_lines"), total(full).alias("chars"), total(full_of(p)).alias("left"), F.array_join(F.transform(p, lambda s: s["x"]), "\n").alias("cleaned")),
                )

            return let(F.size(F.array_distinct(full)), of_once)

        return let(full_of(rows), of_full)

    t = F.coalesce(text, F.lit(""))
    rows = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("x"), is_blank(x).alias("blank")))
    measures = docs.withColumn(of, let(word_list(t), of_words)).withColumn(on, let(furniture(t, phrases), lambda p: let(rows, lambda x: of_lines(x, p))))
    base = (F.col(f"{of}.n_words") < LEAST_WORDS) | (100 * F.col(f"{of}.n_repeat_words") > MOST_REPEATED * F.col(f"{of}.n_words"))
    lost = F.col(f"{on}.chars") - F.col(f"{on}.left")
    found = F.struct(
        F.col(f"{of}.n_words").cast("long").alias("n_words"),
        F.col(f"{of}.word_chars").cast("long").alias("word_chars"),
        signs(t, ORNAMENT).cast("long").alias("n_symbols"),
        F.col(f"{on}.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col(f"{of}.n_repeat_words").cast("long").alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & (lost <= F.col(f"{on}.chars") * MOST_LOST)).alias("kept"),
        F.col(f"{on}.cleaned").alias("cleaned"),
    )
    return measures.withColumn(name, found).drop(of, on), name


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): a row for each row.

    A null or empty text has no word and fails. Repeated rows and null keys keep their rows; ties can't arise; other
    columns are ignored; an empty table gives no rows.
    """
    some = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    found, name = judged(some, F.col("text"), phrases)
    return found.select("doc_id", *[F.col(f"{name}.{m}").alias(m) for m in MEASURES])


def clean(docs: DataFrame, text_col: str = "text", phrases: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """The rows of `docs` that are kept, their text without the lines that the verdict counts as lost; all columns stay.

    Failing lines go, and so do lines equal to an earlier one. If no line of a kept text is lost, it stays as it was to the
    last byte. Null and empty texts fail and go. Repeated rows each stay or go alike; an empty table stays empty; columns
    of any name may be there beside the text.
    """
    found, name = judged(docs, named(text_col), phrases)
    # an explode of one text or none: as a filter, Catalyst would work out the whole verdict again beside the text
    left = F.explode(F.when(F.col(f"{name}.kept"), F.array(F.col(f"{name}.cleaned"))).otherwise(F.array().cast("array<string>")))
    return found.select(*[left.alias(c) if c == text_col else named(c) for c in docs.columns])


_SQL_ENDING, _SQL_INNER = (x.replace("IsThai", "Thai").replace("IsLao", "Lao").replace("'", "''") for x in (ENDING, INNER))
_SQL_LINE = rf"""((regexp_matches(right(regexp_replace(x, '[\x20\x09-\x0D]+\z', ''), 4), '{_SQL_ENDING}') or length(x) >= {LEAST_LONG} and regexp_matches(x, '{_SQL_INNER}'))
  and length(x) - length(replace(x, '!!', '')) <= {2 * MOST_SHOUTS}
  and length(regexp_replace(x, '[^{NAVIGATION + ORNAMENT}]+', '', 'g')) * {CHARS_A_SIGN} <= length(x)
  and (length(x) < {LEAST_SHOUT} or regexp_matches(x, '\p{{Ll}}|[^\P{{Lo}}ªº]'))
  and not ({" or ".join("contains(lower(x), '" + p.replace("'", "''") + "')" for p in BOILERPLATE)}))"""

#: DuckDB SQL of verdicts() over the documents table.
VERDICTS_SQL = rf"""
with base as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
words as (select rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from base),
spots as (select rid, unnest(range(1, len(w) - 1)) as i, w from words where len(w) >= 3),
grams as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from spots),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from grams) where n > 1),
repeats as (select rid, count(distinct i + o) as n from twice, (select unnest([0, 1, 2]) as o) group by rid),
lines as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as f from base),
once as (select rid, f, list_distinct(f) as d from lines),
text_of_lines as (select rid, len(f) - len(d) as n_dup, list_sum(list_transform(f, lambda x: length(x))) as chars,
  coalesce(list_sum(list_transform(list_filter(d, lambda x: {_SQL_LINE}), lambda x: length(x))), 0) as kept_chars from once),
measures as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^{ORNAMENT}]+', '', 'g'))::bigint as n_symbols, n_dup::bigint as n_dup_lines,
    coalesce(repeats.n, 0)::bigint as n_repeat_words, coalesce(chars, 0) as chars, coalesce(kept_chars, 0) as kept_chars
  from base join words using (rid) join text_of_lines using (rid) left join repeats using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words)
    and chars - kept_chars <= chars * {MOST_LOST} as kept
from measures
"""
