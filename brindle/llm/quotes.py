"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that begin with ``>`` marks are quotes of that nesting level. Maximal runs of lines of
one level are passages. Passages are normalised (no marks, lower case, single spaces, line
breaks as spaces) and hashed, as is each of their lines and paragraphs.
What a message itself says (level 0) is hashed in the same way; of equal passages of a
conversation the earliest message is the original. A quoted passage is linked to the original of
the whole passage, else to the one that wrote most of its longer lines and paragraphs, else of all its lines.

A message answers the original of its least nested linked passage. Roots and depths of reply
trees come from pointer doubling, so a chain of n replies takes log2 n joins. Conversations are
put in reply order (tree by tree, in each by depth, then turn: every message stands behind the
one it answers) by a range sort of keys, so a conversation of any size is spread over tasks. Texts are
shuffled once, for the last join; a text without a quote mark is not taken apart.

Joins on passages are by (conversation, hash) and one row on the side of originals, so common
phrases make no pairs.

Defined results: null and empty texts have an empty body and no links; null conversations form
one conversation; a message with a null turn is never an original or linked, and comes last;
rows that repeat a (conversation, turn) are answered as one message, each keeps its row; rows that
repeat the text as well share a position; of passages that are equal or have as many hits the one with the later
turn is answered; texts of any length are read whole, each in one row; an empty table gives no rows; other columns pass through, those named like a result are
replaced; work columns start with ``_q_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut

#: A quote mark: any number of ``>`` with blanks between them, at the start of a line.
MARKS = r"^[ \t]*(?:>[ \t]*)+"
#: How mail programs announce a quote.
ATTRIBUTION = r"(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\b[^\n]*:[ \t]*$"
#: Is there a quote at all?
QUOTED = r"(?m)^[ \t]*>"
MIN_LINE = 16
RESULTS = ("body", "n_quotes", "n_linked", "quote_depth", "parent_turn", "root_turn", "reply_depth", "position")


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_q_quotes``, ``_q_runs``: array of (level, lines), ``_q_own``: lines of its own, and ``body``, the text without quotes."""
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n")
    m = messages.withColumn("_q_raw", F.split(plain, "\n")).withColumn("_q_quotes", plain.rlike(QUOTED))
    mark = lambda line: F.regexp_extract(line, MARKS, 0)
    lines = F.transform("_q_raw", lambda x: F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("t")))
    m = m.withColumn("_q_lines", F.when(F.col("_q_quotes"), lines))
    level = lambda i: F.get(F.col("_q_lines"), i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("_q_lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    m = m.withColumn("_q_starts", F.when(F.col("_q_quotes"), starts))
    end = lambda j: F.coalesce(F.get(F.col("_q_starts"), j + 1), F.size("_q_lines"))
    run = lambda s, j: F.struct(level(s).alias("level"), F.slice("_q_lines", s + 1, end(j) - s)["t"].alias("lines"))
    whole = F.array(F.struct(F.lit(0).alias("level"), F.col("_q_raw").alias("lines")))
    m = m.withColumn("_q_runs", F.when(F.col("_q_quotes"), F.transform("_q_starts", run)).otherwise(whole))
    # A line that announces a quote goes with it: the last line of a level-0 run that a quote follows.
    own = F.transform(
        "_q_runs",
        lambda r, j: F.when(r["level"] > 0, F.array().cast("array<string>")).when(
            (j + 1 < F.size("_q_runs")) & F.element_at(r["lines"], -1).rlike(ATTRIBUTION), F.slice(r["lines"], F.lit(1), F.size(r["lines"]) - 1)
        ).otherwise(r["lines"]),
    )
    m = m.withColumn("_q_own", own)
    return m.withColumn("body", F.trim(F.array_join(F.flatten("_q_own"), "\n"))).drop("_q_raw", "_q_lines", "_q_starts")


def _squeezed(lines):
    return F.transform(lines, lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))


def _keys(lines):
    """Structs (hash, whole, long) of a passage, its lines and its paragraphs; a passage of blanks has none."""
    s = _squeezed(lines)
    n = F.filter(s, lambda x: x != "")
    whole = F.array_join(n, " ")
    paragraphs = F.transform(F.split(F.array_join(s, "\n"), "\n{2,}"), lambda x: F.trim(F.translate(x, "\n", " ")))
    paragraphs = F.array_except(paragraphs, F.concat(F.array(whole, F.lit("")), n))
    key = lambda x, is_whole: F.struct(F.xxhash64(x).alias("hash"), F.lit(is_whole).alias("whole"), (F.lit(is_whole) | (F.length(x) >= MIN_LINE)).alias("long"))
    first = F.filter(F.array(whole), lambda x: x != "")
    return F.concat(F.transform(first, lambda x: key(x, True)), F.transform(F.concat(n, paragraphs), lambda x: key(x, False)))


def quote_links(parsed: DataFrame) -> DataFrame:
    """(_q_c, turn, _q_id, run, level, original) of every quoted passage; original is null where none is found."""
    base = parsed.select("_q_c", "_q_t", "_q_id", "_q_quotes", "_q_runs", "_q_own")
    # Outer generators and filters behind them: a filter on what was parsed would be pushed below, and parse every text line by line again.
    own = base.select("_q_c", "_q_t", F.explode_outer(F.flatten(F.transform(F.filter("_q_own", lambda x: F.size(x) > 0), _keys))).alias("k"))
    said = own.filter("_q_t is not null and k is not null").groupBy("_q_c", F.col("k.hash").alias("hash")).agg(F.min("_q_t").alias("first"))
    quotes = base.filter("_q_quotes").select("_q_c", "_q_t", "_q_id", F.posexplode_outer("_q_runs").alias("run", "r")).filter("r.level > 0")
    keys = quotes.select("_q_c", "_q_t", "_q_id", "run", F.col("r.level").alias("level"), F.explode_outer(_keys(F.col("r.lines"))).alias("k"))
    keys = keys.select("_q_c", "_q_t", "_q_id", "run", "level", F.col("k.hash").alias("hash"), F.col("k.whole").alias("whole"), F.col("k.long").alias("long"))
    found = keys.join(said, ["_q_c", "hash"], "left").withColumn("first", F.when(F.col("first") < F.col("_q_t"), F.col("first")))
    votes = found.groupBy("_q_c", "_q_t", "_q_id", "run", "level", "first").agg(F.max(F.col("whole") & F.col("first").isNotNull()).alias("whole"), F.count_if("long").alias("longer"), F.count(F.lit(1)).alias("hits"))
    best = F.max(F.when(F.col("first").isNotNull(), F.struct("whole", "longer", "hits", "first")))["first"]
    return votes.groupBy("_q_c", "_q_t", "_q_id", "run", "level").agg(best.alias("original"))


def reply_chains(parents: DataFrame) -> DataFrame:
    """(_q_c, _q_t, root, depth) of messages with a parent, by pointer doubling over (_q_c, _q_t, parent)."""
    state = cut(parents.select("_q_c", "_q_t", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = state.select("_q_c", F.col("_q_t").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        step = cut(state.join(up, ["_q_c", "root"], "left"))
        state = step.select("_q_c", "_q_t", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if step.filter("further is not null").isEmpty():
            return state


def build_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` with body, n_quotes, n_linked, quote_depth, parent_turn, root_turn, reply_depth and position."""
    keyed = messages.drop(*RESULTS).withColumns(
        {
            "_q_c": F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n")),
            "_q_t": F.col(turn_col),
            "_q_id": F.md5(F.coalesce(F.col(text_col), F.lit(""))),
        }
    )
    parsed = parse(keyed, text_col)
    links = cut(quote_links(parsed))
    linked = F.col("original").isNotNull()
    answers = F.min(F.when(linked, F.struct("level", "run", "original")))["original"]
    per_message = links.groupBy("_q_c", "_q_t", "_q_id").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count_if(linked).alias("n_linked"), F.max("level").alias("quote_depth"), answers.alias("parent_turn")
    )
    parents = per_message.filter("parent_turn is not null").groupBy("_q_c", "_q_t").agg(F.min("parent_turn").alias("parent"))
    chains = reply_chains(parents).select("_q_c", "_q_t", F.col("root").alias("_q_root"), F.col("depth").alias("_q_depth"))
    keys = keyed.select("_q_c", "_q_t", "_q_id").distinct()
    rows = keys.join(per_message.filter("_q_t is not null"), ["_q_c", "_q_t", "_q_id"], "left").join(chains, ["_q_c", "_q_t"], "left")
    rows = rows.withColumns(
        {
            "n_quotes": F.coalesce("n_quotes", F.lit(0)),
            "n_linked": F.coalesce("n_linked", F.lit(0)),
            "quote_depth": F.coalesce("quote_depth", F.lit(0)),
            "root_turn": F.coalesce("_q_root", "_q_t"),
            "reply_depth": F.coalesce("_q_depth", F.lit(0)),
        }
    ).drop("_q_root", "_q_depth")
    order = [F.col("_q_c"), F.col("root_turn").asc_nulls_last(), F.col("reply_depth"), F.col("_q_t").asc_nulls_last(), F.col("_q_id")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_q_at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumns({"_q_part": F.shiftright("_q_at", 33), "_q_local": F.col("_q_at").bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = dealt.groupBy("_q_c", "_q_part").agg(F.count(F.lit(1)).alias("_q_n"), F.min("_q_local").alias("_q_from"))
    before = Window.partitionBy("_q_c").orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_q_before", F.coalesce(F.sum("_q_n").over(before), F.lit(0)))
    placed = dealt.join(parts, ["_q_c", "_q_part"]).withColumn("position", F.col("_q_before") + F.col("_q_local") - F.col("_q_from"))
    placed = placed.select(F.col("_q_c").alias("_q_pc"), F.col("_q_t").alias("_q_pt"), F.col("_q_id").alias("_q_pid"), *RESULTS[1:])
    same = (F.col("_q_c") == F.col("_q_pc")) & F.col("_q_t").eqNullSafe(F.col("_q_pt")) & (F.col("_q_id") == F.col("_q_pid"))
    out = parse(keyed.join(placed, same), text_col)
    return out.select(*[c for c in messages.columns if c not in RESULTS], *RESULTS)
