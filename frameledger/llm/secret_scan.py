"""Secret scan in SQL functions: three kinds of pattern, and sliding-window entropy over candidate strings.

The place of a match is the length of all that split() and regexp_extract_all() return before it. Sums run
over blocks of matches, so that the work grows with their number and not with its square. A candidate string is a
run of characters that base64 or hex text may hold. The entropy of its windows is kept up by the counts of
the character that enters and of the one that leaves. No pattern here repeats a group without a bound, as
Java's matcher would recurse once for each repetition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, group that is measured, least length of it. Of hex and access only
#: the runs of full length are matched, which are the same ones.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KNOWN = f"^(?:{ASSIGN}|{ACCESS}|{HEX})$"

#: Entropy: windows of WINDOW characters. Classes of a window by its characters, the first that fits, and the bits per
#: character from which a window is random enough. Letters alone need both cases and that these change often.
WINDOW = 20
CLASSES = {
    "hexadecimal": (r"(?=.*[0-9])(?:(?=.*[a-f])[0-9a-f]++|(?=.*[A-F])[0-9A-F]++)", 3.0),
    "lower": (r"(?=.*[a-z])(?=.*[0-9])[a-z0-9_=-]++", 3.7),
    "upper": (r"(?=.*[A-Z])(?=.*[0-9])[A-Z0-9_=-]++", 3.7),
    "mixed": (r"(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9+/_=-]++", 3.9),
    "letters": (r"(?=.*?(?:[A-Z]++[a-z]++){5})[A-Za-z+/_=-]++", 3.9),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The allow-list. A candidate falls into pieces; a UUID, or a piece with one of these words, is blanked, and so are runs of one character.
PIECES = r"(?<=[/=])|(?<=[_-]{2})"
ALLOWED = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}[/=_-]*$|(?i:example|lorem|sample|placeholder|changeme)"
RUN = r"(.)\1{5}"
#: Matches in a block of sums.
BLOCK = 256
SPANS = "array<struct<start:int,end:int,found:string>>"


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of a pattern's matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["found"]), F.lit(0))
        # the piece behind the last match has no match with it
        out = F.when(x["found"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found")))))
        return F.struct(end.alias("at"), out.alias("out"))

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["found"].alias("found")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def blocks(all_steps: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(all_steps) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_steps, k * BLOCK + 1, BLOCK))
        own = F.transform(parts, lambda part: F.aggregate(part, begin, step))
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), join, lambda acc: F.flatten(acc["out"]))

    return bound(steps, blocks)


def over_windows(candidate: Column, start: Column, window: int, judge) -> Column:
    """Goes over the windows of an ASCII string: judge(state, entropy, window's text) gives the next state, and the last one is returned.

    The sum of c * log2(c) over the counts c of a window's characters changes by two terms from one window to the
    next: the counts, among the characters that both share, of the one that enters and of the one that leaves.
    """
    grows = F.array(*[F.lit((k + 1) * math.log2(k + 1) - (k * math.log2(k) if k else 0)) for k in range(window + 1)])

    def go(text: Column) -> Column:
        def at(i: Column, n) -> Column:
            return F.substring(text, i, n).cast("string")

        def step(acc: Column, i: Column) -> Column:
            shared = at(F.greatest(i - window + 1, F.lit(1)), F.least(i - 1, F.lit(window - 1)))
            count = lambda c: F.length(shared) - F.length(F.replace(shared, c, F.lit("")))
            leaves = F.when(i > window, F.get(grows, count(at(i - window, F.lit(1))))).otherwise(0.0)
            total = acc["sum"] + F.get(grows, count(at(i, F.lit(1)))) - leaves
            full = lambda s: F.when(i >= window, judge(acc["state"], math.log2(window) - s / window, at(i - window + 1, F.lit(window)))).otherwise(acc["state"])
            return bound(total, lambda s: F.struct(s.alias("sum"), full(s).alias("state")))

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.struct(F.lit(0.0).alias("sum"), start.alias("state")), step, lambda acc: acc["state"])

    return bound(candidate.cast("binary"), go)


def entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, bits per character, of any window of a candidate string."""
    return over_windows(candidate, F.lit(0.0), window, lambda state, bits, _: F.greatest(state, bits))


def random_looking(candidate: Column) -> Column:
    """Whether any window is random enough for its class. What the allow-list covers is blank and in no class."""
    blank = F.transform(F.split(candidate, PIECES), lambda x: F.when(x.rlike(ALLOWED), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    cleared = F.regexp_replace(F.array_join(blank, ""), RUN, " " * 6)
    lowest = min(bits for _, bits in CLASSES.values())

    def judge(state: Column, bits: Column, text: Column) -> Column:
        least = F.lit(None).cast("double")
        for pattern, limit in reversed(CLASSES.values()):
            least = F.when(text.rlike(f"^(?:{pattern})$"), F.lit(limit)).otherwise(least)
        # the class is only looked for where it can matter
        return F.when(state, True).when(bits < lowest - 1e-9, False).otherwise(F.coalesce(bits >= least - 1e-9, F.lit(False)))

    return over_windows(cleared, F.lit(False), WINDOW, judge)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the arrays of spans found in every whole text: assign, access, hex and entropy.

    Each span is struct<start, end, found>. Patterns match leftmost and without overlap in their kind;
    matches that are too short are dropped. entropy adds candidate strings that a pattern has not yet
    reported as a whole. Reads doc_id and text; other columns have no effect. A null text counts as empty
    and has no spans; repeated rows each give a row; a null doc_id stays null; an empty table gives no rows.
    All of it is SQL functions inside one scan; there is no shuffle.
    """
    none = F.array().cast(SPANS)
    text = F.col("text")
    measured = lambda m: F.char_length(F.regexp_extract(m["found"], ASSIGN, 2)) >= ASSIGN_LEAST
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).select(
        "doc_id",
        F.when(text.rlike(ASSIGN), F.filter(matches(text, ASSIGN), measured)).otherwise(none).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), matches(text, ACCESS)).otherwise(none).alias("access"),
        F.when(text.rlike(HEX), matches(text, HEX)).otherwise(none).alias("hex"),
        # a candidate inside an assignment is matched with it; one that an access key or a hex run covers is that key or run
        F.when(text.rlike(CANDIDATE), F.filter(matches(text, f"{ASSIGN}|{CANDIDATE}"), lambda m: ~m["found"].rlike(KNOWN) & random_looking(m["found"]))).otherwise(none).alias("entropy"),
    )


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the columns of the query."""
    kinds = ["assign", "access", "hex", "entropy"]

    def tagged(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def listed(names: list[str]) -> Column:
        ordered = F.array_sort(F.concat(*[tagged(i, n) for i, n in enumerate(names)]))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds[:3]],
        F.sha2(listed(kinds[:3]).cast("binary"), 256).alias("base_sha256"),
        listed(kinds).alias("spans"),
    )
