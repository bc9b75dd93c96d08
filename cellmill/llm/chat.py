"""Chat formatting into budgeted windows, with DataFrame functions only.

A conversation becomes training windows of at most `budget` tokens. Prefix sums of the turns' tokens choose the spans: a span
takes turns as long as the sum since its start fits beside the system turn and the history allowance, so windows end where
turns end. Each window repeats the conversation's first system turn, if that has half the budget or less, and the latest turns before its span whose tokens
sum to `history` or less. The loss mask covers texts of the target role in the span alone: repeated turns are masked out, so every
target counts once.

Template: <|start|>role<|sep|>text<|end|>. Control strings (the template's and common foreign ones) inside a role or text
get a backslash after their first character; strings that already look so get one more, which makes it reversible.

Prefix sums don't need a whole conversation in one task: turns are sorted into ranges, summed within each, and ranges get the sums
of those before them. By its prefix sum a turn falls into a section of SECTION_WINDOWS windows' worth of tokens, and sections are formatted
independently. Where a section's first span starts is known beforehand: for the few turns that it may start with, numbers alone are followed
from span to span into the next section, and a conversation's sections are chained by these. So spans run on across sections, and are those that one pass
over the whole conversation would choose.

A longer system turn stands in its place once, as any turn, and is not repeated: repeats would be most of what is trained on.

Tokens are estimated from the text: a mark or letter of a script without spaces is one, a word of other letters one for every four
characters. Pass `tokens` to count by another rule.

Edge cases: null roles and texts are empty; a null turn counts as turn -1; a null conversation id is a conversation;
repeated rows are turns each, and ties of the turn number go by role, then the first TIE_CHARS characters of the text, then its hash; a turn beyond the budget has a window of its
own and is never cut; an empty table gives no windows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmill.llm.common import cut

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: What starts a control string, and what may follow (the template's own, then foreign ones).
_HEADS = r"([<\[])"
_TAILS = r"(\|(?:start|sep|end)\|>|/?s>|/?INST\])"
BUDGET = 1024
HISTORY = 256
SECTION_WINDOWS = 64
#: Rows of section starts that may be broadcast; only conversations of several sections have any.
BROADCAST_STARTS = 100_000
TIE_CHARS = 64
TURN_MARKS = 4
#: Letters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Han, fullwidth forms.
_NO_SPACES = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F"
_TOKEN = rf"[{_NO_SPACES}]|[\p{{L}}\p{{M}}\p{{N}}_]{{1,4}}|[^\p{{L}}\p{{M}}\p{{N}}_\s]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _HEADS + r"(\\*)" + _TAILS, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _HEADS + r"(\\*)\\" + _TAILS, "$1$2$3")


def estimated_tokens(text: Column) -> Column:
    """One for every four letters of a word, for a mark, and for a letter of a script without spaces."""
    return F.regexp_count(text, F.lit(_TOKEN))


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, tokens) -> DataFrame:
    """conv, turn, role, role_out, text_out, tokens, before: the tokens of the conversation's turns before this one; in_all: those of all."""
    role, text = F.coalesce(rows[role_col], F.lit("")), F.coalesce(rows[text_col], F.lit(""))
    text_head, digest = F.substr(text, F.lit(1), F.lit(TIE_CHARS)), F.xxhash64(text)
    turn = F.coalesce(rows[turn_col].cast("long"), F.lit(-1))
    plain = rows.select(rows[conv_col].alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), text_head.alias("head"), digest.alias("digest"))
    order = ["turn", "role", "head", "digest", "tie"]  # turns equal up to the tie are equal, so any order does
    ranges = plain.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv", *order)
    dealt = cut(ranges.select(  # tokens and escapes come after the sort, which reads its input twice
        "conv", *order, escape(F.col("role")).alias("role_out"), escape(F.col("text")).alias("text_out"),
        (tokens(F.col("text")).cast("long") + TURN_MARKS).alias("tokens"), F.spark_partition_id().alias("part"),
    ))
    parts = dealt.groupBy(F.col("conv").alias("of"), F.col("part").alias("in_part")).agg(F.sum("tokens").alias("sum"))
    earlier = F.coalesce(F.sum("sum").over(Window.partitionBy("of").orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(parts.select("of", "in_part", earlier.alias("offset"), F.sum("sum").over(Window.partitionBy("of")).alias("in_all")))
    within = F.sum("tokens").over(Window.partitionBy("part", "conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = dealt.withColumn("within", within).join(offsets, (F.col("part") == F.col("in_part")) & F.col("conv").eqNullSafe(F.col("of")))
    return placed.select("conv", "turn", "role", "role_out", "text_out", "tokens", (F.col("within") + F.col("offset")).alias("before"), "in_all")


def _starts(turns: Column, room: Column) -> Column:
    """Positions (from 1) in turns at which spans begin, and one past the end. Turns of the section before come first, marked old."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("begin"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, t: Column) -> Column:
        opens = ~t["old"] & ((F.size(acc["starts"]) == 0) | (t["before"] + t["tokens"] - acc["begin"] > room))
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(opens, t["before"]).otherwise(acc["begin"]).alias("begin"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["at"] + 1))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(turns, start, step, lambda acc: F.concat(acc["starts"], F.array(acc["at"] + 1)))


def _section_starts(turns: DataFrame) -> DataFrame:
    """Where the first span of each section starts, for conversations of several sections: of, in_section, entry (tokens before). A section
    without a start has no row. turns: conv, before, tokens, room, size, section.

    The span after one that starts at `before` starts at the last turn not more than `room` further on, or at the next turn where that is none."""
    long = turns.filter("in_all > size").select("conv", "before", "tokens", "room", "size", "section")
    end, limit = F.col("before") + F.col("tokens"), F.col("before") + F.col("room")
    early = (F.col("section") > 0) & (F.col("before") <= F.col("section") * F.col("size") + F.col("room"))  # a span of the section before may reach it
    place = lambda number, own: F.struct(number.alias("part"), F.lit(own).alias("own"))
    own = place(F.col("section"), True)
    placed = long.withColumn("place", F.explode(F.when(early, F.array(own, place(F.col("section") - 1, False))).otherwise(F.array(own)))).select("*", "place.*")
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("conv", "part").orderBy("before")))
    turn = F.struct("at", "before", end.alias("end"))
    nothing = F.lit(None).cast("struct<at:int,before:bigint,end:bigint>")
    event = lambda pos, kind, seen: F.struct(pos.alias("pos"), F.lit(kind).alias("kind"), seen.alias("seen"))
    a_turn, asks = event(F.col("before"), 0, turn), event(limit, 1, nothing)
    events = numbered.withColumn("event", F.explode(F.when(F.col("own"), F.array(a_turn, asks)).otherwise(F.array(a_turn)))).select("*", "event.*")
    last = F.last("seen", ignorenulls=True).over(Window.partitionBy("conv", "part").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    step = lambda at, before: F.struct(at.alias("at"), before.alias("before"))
    after = (
        F.when(F.col("last.at") == F.col("at"), step(F.col("at") + 1, end))
        .when(F.col("last.end") <= limit, step(F.col("last.at") + 1, F.col("last.end")))
        .otherwise(step(F.col("last.at"), F.col("last.before")))
    )
    jumps = events.withColumn("last", last).filter("kind = 1").select("conv", "part", "at", "before", "size", "room", after.alias("next"))
    listed = jumps.groupBy("conv", "part", "size", "room").agg(F.array_sort(F.collect_list(F.struct("at", "before", "next"))).alias("own"))
    may_start = F.filter("own", lambda t: (t["at"] == 1) | (t["before"] < F.col("part") * F.col("size") + F.col("room")))

    def leaves(start: Column) -> Column:
        """Where the span after the section's last starts, if its first starts there."""
        jump = lambda now, _: F.when(now["at"] <= F.size("own"), F.get("own", now["at"] - 1)["next"]).otherwise(now)
        return F.aggregate(F.sequence(F.lit(1), F.lit(2 * SECTION_WINDOWS + 2)), step(start["at"], start["before"]), jump)["before"]

    ways = listed.select("conv", "part", "size", F.transform(may_start, lambda t: F.struct(t["before"].alias("entry"), leaves(t).alias("leave"))).alias("ways"))
    chained = ways.groupBy("conv", "size").agg(F.array_sort(F.collect_list(F.struct("part", "ways"))).alias("parts"))
    begin = F.struct(F.lit(0).cast("long").alias("now"), F.array().cast("array<struct<part:bigint,entry:bigint>>").alias("entries"))

    def through(acc: Column, p: Column) -> Column:
        here = F.floor(acc["now"] / F.col("size")) == p["part"]
        way = F.get(F.filter(p["ways"], lambda w: w["entry"] == acc["now"]), F.lit(0))
        found = F.concat(acc["entries"], F.array(F.struct(p["part"].alias("part"), acc["now"].alias("entry"))))
        return F.struct(F.when(here, way["leave"]).otherwise(acc["now"]).alias("now"), F.when(here, found).otherwise(acc["entries"]).alias("entries"))

    entries = chained.select(F.col("conv").alias("of_conv"), F.explode(F.aggregate("parts", begin, through)["entries"]).alias("e"))
    return cut(entries.select("of_conv", F.col("e.part").alias("in_section"), "e.entry"))


def windows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, target: str = "assistant", tokens=estimated_tokens) -> DataFrame:
    """One row per window: conv, section, span (their order within a conversation), n_repeated (turns in front that an earlier
    window has), n_new, n_tokens, formatted, loss (array of [start, end) in code points of formatted)."""
    turns = cut(_turns(rows, conv_col, turn_col, role_col, text_col, tokens))
    first_system = F.min_by(F.struct("before", "role_out", "text_out", "tokens"), "before")
    systems = cut(turns.filter(F.col("role") == "system").groupBy(F.col("conv").alias("of")).agg(first_system.alias("system")).filter(F.col("system.tokens") * 2 <= budget))
    of_conv = F.col("conv").eqNullSafe(F.col("of"))
    room = F.greatest(F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0)), F.lit(1)).cast("long")
    roomy = turns.join(systems.select("of", F.col("system.tokens").alias("system_tokens")), of_conv, "left").withColumn("room", room)
    sized = roomy.withColumn("size", F.greatest(F.col("room") * SECTION_WINDOWS, F.lit(4 * history + 1)))
    in_sections = sized.withColumn("section", F.floor(F.col("before") / F.col("size")))
    starts = _section_starts(in_sections)
    small = starts.limit(BROADCAST_STARTS + 1).count() <= BROADCAST_STARTS
    with_start = in_sections.join(F.broadcast(starts) if small else starts, F.col("conv").eqNullSafe(F.col("of_conv")) & (F.col("section") == F.col("in_section")), "left")
    place = lambda number, old: F.struct(number.alias("of_section"), F.lit(old).alias("old"))
    section = F.col("section")
    carried = (section > 0) & (F.col("entry").isNull() | (F.col("before") < F.col("entry")))  # still in a span of the section before
    late = F.col("before") >= (section + 1) * F.col("size") - history
    places = F.concat(
        F.when(carried, F.array(place(section - 1, False), place(section, True))).otherwise(F.array(place(section, False))),
        F.when(late, F.array(place(section + 1, True))).otherwise(F.array().cast("array<struct<of_section:bigint,old:boolean>>")),
    )
    dealt = with_start.withColumn("place", F.explode(places)).select("conv", "room", "before", "role", "role_out", "text_out", "tokens", F.col("place.of_section").alias("section"), "place.old")
    sections = (
        dealt.groupBy("conv", "section", "room")
        .agg(F.array_sort(F.collect_list(F.struct("before", "role", "role_out", "text_out", "tokens", "old"))).alias("turns"))
        .filter(F.exists("turns", lambda t: ~t["old"]))
    )
    started = sections.join(systems, of_conv, "left").withColumn("starts", _starts(F.col("turns"), F.col("room")))
    same_as_system = lambda t: F.coalesce(t["before"] == F.col("system.before"), F.lit(False))
    piece = lambda t, own: F.struct(t["role_out"].alias("role_out"), t["text_out"].alias("text_out"), t["tokens"].alias("tokens"), own.alias("own"))
    reach = history // TURN_MARKS + 1  # a turn has TURN_MARKS tokens or more, so history has no more turns

    def window(k: Column) -> Column:
        begin, after = F.get("starts", k), F.get("starts", k + 1)
        oldest = F.greatest(F.lit(1), begin - reach)
        base = F.get("turns", begin - 1)["before"]
        recent = F.filter(F.slice("turns", oldest, begin - oldest), lambda t: (base - t["before"] <= history) & ~same_as_system(t))
        return F.struct(k.alias("span"), F.slice("turns", begin, after - begin).alias("new"), recent.alias("recent"))

    each = started.select("conv", "section", "system", F.explode(F.transform(F.sequence(F.lit(0), F.size("starts") - 2), window)).alias("w")).select("*", "w.*")
    nothing = F.array().cast("array<struct<role_out:string,text_out:string,tokens:bigint,own:boolean>>")
    system = F.when(F.col("system").isNotNull() & ~F.exists("new", same_as_system), F.array(piece(F.col("system"), F.lit(False)))).otherwise(nothing)
    parts = each.select(
        "conv", "section", "span",
        F.concat(system, F.transform("recent", lambda t: piece(t, F.lit(False)))).alias("repeated"),
        F.transform("new", lambda t: piece(t, t["role"] == target)).alias("new"),
    ).withColumn("pieces", F.concat("repeated", "new"))
    head = lambda p: F.concat(F.lit(START), p["role_out"], F.lit(SEP))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def mark(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(head(p))
        end = start + F.length(p["text_out"])
        masked = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(p["own"], F.concat(acc["loss"], masked)).otherwise(acc["loss"]).alias("loss"))

    return parts.select(
        "conv", "section", "span", F.size("repeated").alias("n_repeated"), F.size("new").alias("n_new"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("pieces", lambda p: F.concat(head(p), p["text_out"], F.lit(END))), "").alias("formatted"),
        F.aggregate("pieces", begin, mark, lambda acc: acc["loss"]).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window: array of (role, text), unescaped."""
    marked = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: F.startswith(p, F.lit(START)))
    both = F.transform(marked, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|sep\|>", 2))
    return F.transform(both, lambda b: F.struct(unescape(b[0]).alias("role"), unescape(b[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(loss, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["end"] - m["start"])))
