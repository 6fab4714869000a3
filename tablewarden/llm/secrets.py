"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Candidates are runs of token characters at least a window long. Within a run a window moves by one
character at a time; its character counts, and the sum of c * log2(c) over them, are carried along and
changed for the entering and the leaving character only, which gives the Shannon entropy of every window.
Windows at or above the threshold of the run's character class are joined to spans. Every run has a
class, and every threshold can be reached by a window of it. Runs on the allow-list, and spans inside a
pattern match, are left out. A placeholder word allows a run only if no window's length beside it is free
of such words.

The allow-list judges runs with separators by the pieces between them: names and paths (letters in one
case, or with a capital first, and short numbers) are no secrets, whatever their entropy. Nor are numbers
that begin with a date or count upwards. No pattern repeats a group, so runs of any length are matched
without recursion.

Positions count code points. Everything is built from SQL functions. Where matches lie is found by
putting a mark around each and summing the lengths between marks; the marks are control characters
that no pattern matches, and texts that hold them get others first.

Defined cases: null is the empty text and has no spans; each row is judged alone, so repeated rows
repeat; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern kinds in order; a match counts by the length of its last part.
ASSIGN_KEY = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
PATTERNS = (
    ("assign", f"({ASSIGN_KEY})({ASSIGN_VALUE})", 6),
    ("access", "()(AKIA[A-Z0-9]{16,})", 20),
    ("hex", "()([0-9a-f]{24,})", 24),
)
MARK, INNER, OTHER = "\x01", "\x02", "\x03"
BLOCK = 256


#: Characters of a window, and words of tokens that are none.
WINDOW = 20
PLACEHOLDER = "(?:example|sample|placeholder|changeme|xxxx|dummy|abcdefgh|0123456789|qwerty)"


@dataclass(frozen=True)
class EntropyRules:
    """A class is a pattern that a whole run matches and the bits a window of it needs; the first that fits holds."""

    window: int = WINDOW
    #: ASCII characters only.
    run: str = "[A-Za-z0-9+/_=-]"
    classes: tuple[tuple[str, float], ...] = (
        ("^[0-9]+$", 2.5),
        ("^[0-9a-fA-F]+$", 3.0),
        ("^(?=.*[0-9])(?=.*[a-zA-Z]).*$", 3.7),
        ("^(?=.*[a-z])(?=.*[A-Z]).*$", 3.8),
        ("^.*[a-zA-Z].*$", 3.5),
        ("^.*$", 2.5),
    )
    allow: tuple[str, ...] = (
        f"(?i)^(?=.*{PLACEHOLDER})(?!(?:.*{PLACEHOLDER})?(?:(?!{PLACEHOLDER}).){{{WINDOW}}})",
        "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        "^(?!.*//)[a-z/]+$",
        # Pieces between separators: no change of case but after a first capital, no letter beside a digit, none long.
        "^(?=.*[_/-])(?!.*(?:[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Za-z]{20}|[0-9]{9}|[_/-]{3}))[A-Za-z0-9_/-]+$",
        "^[0-9]*(?:012345|123456|234567|345678|456789)[0-9]*$",
        "^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]*$",
    )


def running_sums(df: DataFrame, numbers: str, result: str) -> DataFrame:
    """``result`` holds for each entry of the array the sum of those before it; worked in blocks, as arrays grow by copying."""
    return (
        df.withColumn(
            "blocks_",
            F.expr(
                f"transform(sequence(0, (size({numbers}) - 1) div {BLOCK}), b -> aggregate(slice({numbers}, b * {BLOCK} + 1, {BLOCK}), "
                "array(0L), (a, v) -> array_append(a, element_at(a, -1) + v)))"
            ),
        )
        .withColumn("bases_", F.expr("aggregate(blocks_, array(0L), (a, s) -> array_append(a, element_at(a, -1) + element_at(s, -1)))"))
        .withColumn(result, F.expr("flatten(transform(blocks_, (s, b) -> transform(slice(s, 1, size(s) - 1), v -> v + bases_[b])))"))
        .drop("blocks_", "bases_")
    )


def matches(df: DataFrame, text: str, pattern: str, result: str) -> DataFrame:
    """``result``: array of (start, end, body) of the matches; ``pattern`` has two groups, ``body`` is the second."""
    marked = (
        df.withColumn("marked_", F.regexp_replace(text, pattern, f"{MARK}$1{INNER}$2{MARK}"))
        .withColumn("parts_", F.when(F.contains("marked_", F.lit(MARK)), F.split("marked_", MARK)).otherwise(F.array(F.lit(""))))
        .withColumn("lengths_", F.transform("parts_", lambda p: F.length(F.translate(p, INNER, "")).cast("long")))
    )
    return (
        running_sums(marked, "lengths_", "starts_")
        .withColumn(
            result,
            F.expr(
                "transform(filter(sequence(0, size(parts_) - 1), i -> i % 2 = 1), i -> named_struct("
                f"'start', starts_[i], 'end', starts_[i] + lengths_[i], 'body', split_part(parts_[i], '{INNER}', 2)))"
            ),
        )
        .drop("marked_", "parts_", "lengths_", "starts_")
    )


#: The counts of a window are a text with one letter per ASCII character, this one for none.
_NONE = 64
_CHARACTERS = 128


def window_spans(run: Column, threshold: Column, window: int) -> Column:
    """Spans (from, to) of a run's windows whose entropy reaches the threshold; ``run`` is an array of ASCII characters.

    For counts c in a window of w characters the entropy is log2(w) - sum(c log2 c) / w. The state holds
    the counts of the window's characters and the sum. ``last`` is the span that may still grow.
    """
    if window >= _CHARACTERS - _NONE:
        raise ValueError(f"a window has less than {_CHARACTERS - _NONE} characters")
    term = [c * math.log2(c) if c > 1 else 0.0 for c in range(window + 2)]
    # What the sum gains by one more of a character that stands there c times.
    gain = F.array(*[F.lit(term[c + 1] - term[c]) for c in range(window + 1)])
    codes = F.transform(run, F.ascii)
    steps = F.zip_with(codes, F.concat(F.array_repeat(F.lit(-1), window), codes), lambda enter, leave: F.struct(enter.alias("enter"), leave.alias("leave")))
    steps = F.filter(F.transform(steps, lambda s, i: F.struct(i.alias("at"), s["enter"].alias("enter"), s["leave"].alias("leave"))), lambda s: s["enter"].isNotNull())

    def move(state: Column, step: Column) -> Column:
        counts, enter, leave = state["counts"], step["enter"], step["leave"]
        count = lambda code: F.ascii(F.substr(counts, code + 1, F.lit(1))) - _NONE
        put = lambda held, code, n: F.overlay(held, F.char(n + _NONE), code + 1, F.lit(1))
        gone = F.when(leave >= 0, F.get(gain, count(leave) - 1)).otherwise(F.lit(0.0))
        # A character that leaves as an equal one enters changes nothing.
        total = F.when(enter == leave, state["total"]).otherwise(state["total"] + F.get(gain, count(enter)) - gone)
        left = F.when(leave >= 0, put(counts, leave, count(leave) - 1)).otherwise(counts)
        end = (step["at"] + 1).cast("long")
        start = end - window
        is_high = (start >= 0) & (total <= (F.lit(math.log2(window)) - threshold + 1e-9) * window)
        joins = state["last"]["to"] >= start
        begun = F.when(joins, state["last"]["from"]).otherwise(start)
        return F.struct(
            total.alias("total"),
            F.when(enter == leave, counts).otherwise(put(left, enter, count(enter) + 1)).alias("counts"),
            F.when(is_high, F.struct(begun.alias("from"), end.alias("to"))).otherwise(state["last"]).alias("last"),
            F.when(joins | (state["last"]["to"] < 0), state["spans"]).when(is_high, F.array_append(state["spans"], state["last"])).otherwise(state["spans"]).alias("spans"),
        )

    span = "struct<from:bigint,to:bigint>"
    empty = F.struct(
        F.lit(0.0).alias("total"),
        F.lit(chr(_NONE) * _CHARACTERS).alias("counts"),
        F.struct(F.lit(-1).cast("bigint").alias("from"), F.lit(-1).cast("bigint").alias("to")).cast(span).alias("last"),
        F.array().cast(f"array<{span}>").alias("spans"),
    )
    return F.aggregate(steps, empty, move, lambda s: F.when(s["last"]["to"] >= 0, F.array_append(s["spans"], s["last"])).otherwise(s["spans"]))


def outside_of(spans: str, others: str) -> Column:
    """The spans that lie in none of the others, by one walk over both in the order of their starts."""
    tagged = lambda name, mark: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(mark).alias("mark"), s["kind"].alias("kind"), s["end"].alias("end")))
    walk = F.array_sort(F.concat(tagged(others, 0), tagged(spans, 1)))
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"

    def step(state: Column, s: Column) -> Column:
        free = (s["mark"] == 1) & (s["end"] > state["reach"])
        own = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
        return F.struct(
            F.when(s["mark"] == 0, F.greatest(state["reach"], s["end"])).otherwise(state["reach"]).alias("reach"),
            F.when(free, F.array_append(state["kept"], own)).otherwise(state["kept"]).alias("kept"),
        )

    return F.aggregate(walk, F.struct(F.lit(-1).cast("bigint").alias("reach"), F.array().cast(kind).alias("kept")), step, lambda state: state["kept"])


def secret_spans(df: DataFrame, rules: EntropyRules = EntropyRules(), text: str = "text") -> DataFrame:
    """The rows with ``base_spans`` and ``all_spans``: arrays of (start, kind, end) by start, then kind.

    Kinds are numbers: the places of PATTERNS, then entropy.
    """
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), MARK + INNER, OTHER + OTHER)
    out = df.withColumn("body_", clean)
    for number, (_, pattern, least) in enumerate(PATTERNS):
        out = matches(out, "body_", pattern, "found_")
        held = F.filter("found_", lambda m: F.length(m["body"]) >= least)
        spans = F.transform(held, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))
        out = out.withColumn(f"kind_{number}_", spans).drop("found_")
    kinds = [F.col(f"kind_{number}_") for number in range(len(PATTERNS))]
    out = out.withColumn("base_spans", F.array_sort(F.concat(*kinds))).drop(*[f"kind_{n}_" for n in range(len(PATTERNS))])
    out = matches(out, "body_", f"()({rules.run}{{{rules.window},}})", "runs_")

    def threshold(run: Column) -> Column:
        chosen = F.lit(None).cast("double")
        for pattern, bits in reversed(rules.classes):
            chosen = F.when(F.rlike(run, F.lit(pattern)), F.lit(bits)).otherwise(chosen)
        return chosen

    def allowed(run: Column) -> Column:
        listed = F.lit(False)
        for pattern in rules.allow:
            listed = listed | F.rlike(run, F.lit(pattern))
        return listed

    judged = F.filter("runs_", lambda r: ~allowed(r["body"]) & threshold(r["body"]).isNotNull())
    judged = F.transform(
        judged,
        lambda r: F.struct(r["start"].alias("start"), F.split(r["body"], "").alias("letters"), threshold(r["body"]).alias("bits")),
    )
    high = lambda r: F.transform(
        window_spans(r["letters"], r["bits"], rules.window),
        lambda s: F.struct((r["start"] + s["from"]).alias("start"), F.lit(len(PATTERNS)).alias("kind"), (r["start"] + s["to"]).alias("end")),
    )
    out = out.withColumn("judged_", judged).withColumn("high_", F.flatten(F.transform("judged_", high)))
    added = outside_of("high_", "base_spans")
    return out.withColumn("all_spans", F.array_sort(F.concat("base_spans", added))).drop("body_", "runs_", "judged_", "high_")


def spans_text(spans: str) -> Column:
    names = F.array(*[F.lit(name) for name, _, _ in PATTERNS], F.lit("entropy"))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def redacted(df: DataFrame, spans: str = "all_spans", text: str = "text", put: str = "[secret]") -> DataFrame:
    """The text with every span replaced; spans that overlap or touch are one."""
    return (
        df.withColumn(
            "joined_",
            F.expr(
                f"aggregate({spans}, cast(array() AS array<struct<start:bigint,end:bigint>>), (a, s) -> "
                "CASE WHEN size(a) > 0 AND element_at(a, -1).end >= s.start "
                "THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))) "
                "ELSE concat(a, array(named_struct('start', s.start, 'end', s.end))) END)"
            ),
        )
        .withColumn(
            text,
            F.expr(
                f"CASE WHEN size(joined_) = 0 THEN {text} ELSE concat(array_join(transform(joined_, (s, i) -> concat("
                f"substr({text}, cast(CASE WHEN i = 0 THEN 0 ELSE joined_[i - 1].end END + 1 AS int), "
                f"cast(s.start - CASE WHEN i = 0 THEN 0 ELSE joined_[i - 1].end END AS int)), '{put}')), ''), "
                f"substr({text}, cast(element_at(joined_, -1).end + 1 AS int))) END"
            ),
        )
        .drop("joined_")
    )
