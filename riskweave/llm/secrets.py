"""Secret scans, by DataFrame functions alone.

Three base patterns give spans of their own: an assignment to a secret-like name, an access
key id, a long run of hexadecimal digits. Beyond them, candidate strings (runs of the base64
characters and of the hexadecimal digits) are scanned by a window that slides one character
at a time: the window keeps a count for every character and the sum of ``c * log2(c)``, both
changed by the character that comes and the one that goes, so its Shannon entropy
``log2(w) - sum / w`` costs a constant number of steps. A candidate is reported when a window
of its class reaches the class's threshold and no allow-list pattern matches it.

Positions are counted in code points, ends exclusive. They are found without user functions:
cutting a text at a pattern gives the pieces between matches, and running sums of the lengths
of pieces and matches give the spans.

Cases: a null or empty text has no spans (the digest of the empty text, an empty list). Texts
of any length are scanned whole. Repeated rows, null ids and ties are scanned row by row; at an equal start,
spans stand in the order of the kinds, then by end. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.llm.common import table

#: kind, pattern, condition on the match. Java's \x20 is the blank.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
# Runs are maximal, so a shorter run dropped afterwards and a run not matched are the same.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: class of characters, candidate pattern, window, least entropy in bits a character.
CLASSES = (
    ("hexadecimal", r"[0-9A-Fa-f]{24,}", 24, 3.0),
    ("base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
)
#: Candidates that look random and are none: one character kind only (words, numbers),
#: identifiers in groups of 8-4-4-4-12, paths, alphabets, documented sample keys.
ALLOW = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[a-z]+([-_/][a-z]+)*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)abcdefghijkl|0123456789abcdef|EXAMPLE",
    r"^[^0-9]*$",
)

_SPAN = "struct<start: bigint, until: bigint, found: string>"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, until, found) of the leftmost non-overlapping matches."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.lit(None).cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.coalesce(empty, F.array().cast(f"array<{_SPAN}>")).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["found"])
        span = F.struct(begin.alias("start"), end.alias("until"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, f: F.struct(p.alias("piece"), f.alias("found")))
    spans = F.aggregate(pairs, start, step, lambda state: state["spans"])
    # Most texts have no match: those skip the cutting.
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def window_entropy(chars: Column, window: int) -> Column:
    """The largest Shannon entropy (bits a character) of any ``window`` successive characters.

    ``chars`` is an array of characters of at least ``window`` entries.
    """
    log2 = 1 / math.log(2)

    def weight(count: Column) -> Column:
        return F.when(count > 0, count * F.log(count) * log2).otherwise(F.lit(0.0))

    alphabet = F.array_distinct(chars)
    places = F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int"))
    zero = F.transform(alphabet, lambda _: F.lit(0))
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    # Each step: the character that comes, and the one that leaves (0: none yet).
    leaving = F.concat(F.array_repeat(F.lit(0), window), F.slice(places, 1, F.greatest(F.size(places) - window, F.lit(0))))
    steps = F.zip_with(places, leaving, lambda a, b: F.struct(a.alias("comes"), b.alias("goes")))
    numbered = F.transform(steps, lambda s, i: F.struct(s["comes"].alias("comes"), s["goes"].alias("goes"), i.alias("at")))

    def step(state: Column, s: Column) -> Column:
        same = s["comes"] == s["goes"]
        comes = F.element_at(state["counts"], s["comes"])
        goes = F.element_at(state["counts"], F.greatest(s["goes"], F.lit(1)))
        gain = weight(comes + 1) - weight(comes)
        loss = F.when(s["goes"] > 0, weight(goes) - weight(goes - 1)).otherwise(F.lit(0.0))
        total = F.when(same, state["sum"]).otherwise(state["sum"] + gain - loss)
        counts = F.transform(
            state["counts"],
            lambda c, i: c + F.when(i + 1 == s["comes"], 1).otherwise(0) - F.when(i + 1 == s["goes"], 1).otherwise(0),
        )
        entropy = math.log2(window) - total / window
        best = F.when(s["at"] + 1 >= window, F.greatest(state["best"], entropy)).otherwise(state["best"])
        return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

    return F.aggregate(numbered, start, step, lambda state: state["best"])


def _entropy_spans(text: Column, allow: tuple[str, ...]) -> Column:
    """Candidates of every class with a window over its threshold and no allow-list match."""

    def of(pattern: str, window: int, least: float) -> Column:
        def keep(span: Column) -> Column:
            allowed = F.lit(False)
            for p in allow:
                allowed = allowed | span["found"].rlike(p)
            return ~allowed & (window_entropy(F.split(span["found"], ""), window) >= least)

        return F.filter(_matches(text, pattern), keep)

    return F.concat(*(of(pattern, window, least) for _, pattern, window, least in CLASSES))


def spans_of(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Array of (start, rank of the kind, until, kind), in order of start, then kind."""
    assign = F.filter(_matches(text, ASSIGN), lambda s: F.length(F.regexp_replace(s["found"], ASSIGN_HEAD, "")) >= 8)
    by_kind = (assign, _matches(text, ACCESS), _matches(text, HEX), _entropy_spans(text, allow))

    def labelled(rank: int) -> Column:
        return F.transform(
            by_kind[rank],
            lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["until"].alias("until"), F.lit(KINDS[rank]).alias("kind")),
        )

    return F.array_sort(F.array_distinct(F.concat(*map(labelled, range(len(KINDS))))))


def listed(spans: Column) -> Column:
    """kind:start:until of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["until"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per document: the secrets' spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), spans_of(text, allow).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every maximal covered stretch replaced by ``mask``; null stays null."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, s: Column) -> Column:
        def part(begin: Column, length: Column) -> Column:
            return F.substr(text, (begin + 1).cast("int"), length.cast("int"))

        apart = F.concat(state["out"], part(state["at"], s["start"] - state["at"]), F.lit(mask))
        return F.struct(
            F.when(s["start"] >= state["at"], apart).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["until"]).alias("at"),
        )

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int"))))
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("entropy"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
