"""Conversation structure repair: window-derived fault flags and a fold of sorted turns that finds the cheapest edits.

A conversation in order has role initials ``(s?(ua)+)?``. Edits of a row are K(eep) for 0, R(erole) to user or assistant for 2 and
D(elete) for 3, I(nsert) of a user or assistant turn without text, anywhere, costs 2; an undeleted truncated row adds 1; blank and
duplicate rows must go. ``aggregate()`` walks a conversation's sorted turn structs and carries four (cost, audit) structs, one for
each state of the pattern: nothing yet, after the system's turn, after a user's, after an assistant's. ``least`` of structs picks the
cheaper, of equal costs the ASCII-least audit. That is exact: audits of equal cost at one state after the same rows can't be prefixes of
each other (the longer would have more inserts), so what follows never turns their order.

Inside, inserts are I (user) and J (assistant) and reroles R (user) and S (assistant); an audit and the rows determine which, so their order
is that of I and R alone. Outside J is I and S is R.

A conversation is folded where its rows meet, after one shuffle. Those of more rows than ``LONG`` (or a millionth of the table, so that
there are fewer than a million of them) are dealt into bins of their order, cut into segments of ``SEGMENT`` turns, folded from each of
the four states at once, and the segments are folded in turn.

Defined results: null role or text is one space, as is a null id or turn in the damage's key; rows are in order of turn (nulls first), then
of role and text by code points; a role is legal by its first character, so a role without one can't be kept; rows with a null conv_id are one
conversation; a conversation without rows after damage has zeros, an empty audit and the hash of the empty string; gaps that don't fit a
long are null; an empty table gives no rows; extra columns are ignored. The repaired text of one conversation must fit one value
(2 GB), as its hash is taken of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import By, beside_bin, with_bins
from .common import WORD_SPACE, cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: Rows of a conversation from which it is folded in segments, the least share of the table's rows, and turns of a segment.
LONG, SHARE, SEGMENT = 4096, 1_000_000, 1024
#: The cost of a state that can't be reached.
NEVER = 1 << 40
STATES = ("e", "s", "u", "a")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of the rows as damaged by their key; dropped rows stay, marked gone, so that no conversation is lost."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _ends(text: Column) -> Column:
    """The last character that is no white space; empty for blank texts."""
    return F.right(F.rtrim(text, F.lit(WORD_SPACE)), F.lit(1))


def _flagged(placed: DataFrame) -> DataFrame:
    """Each row's first fault, and whether its role may not follow the one before; placed has place, seen (of its role and text, from 1), before (struct of the row before)."""
    initial, end = F.left("role", F.lit(1)), _ends(F.col("text"))
    blank = end == ""
    duplicate = ~blank & (F.col("seen") > 1)
    truncated = ~blank & ~duplicate & ~end.isin(".", "!", "?")
    return placed.select(
        "conv_id", "gone", "place", "turn", "role", "text", initial.alias("initial"), blank.alias("blank"), duplicate.alias("duplicate"), truncated.alias("truncated"),
        F.coalesce(~F.concat("before.initial", initial).isin(*LEGAL), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.coalesce(F.col("before.turn") == F.col("turn"), F.lit(False))).alias("new_turn"),
    )


_ORDER = ("turn", "role", "text")


def _placed(rows: DataFrame) -> DataFrame:
    """place, seen and before inside each conversation, by windows over rows that one shuffle has brought together."""
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    own = Window.partitionBy("conv_id", "gone").orderBy(*order)
    return rows.repartition("conv_id").select(
        "*", F.row_number().over(own).alias("place"), F.lag(F.struct("turn", F.left("role", F.lit(1)).alias("initial"))).over(own).alias("before"),
    ).withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("place")))


def _placed_in_bins(rows: DataFrame) -> DataFrame:
    """The same for conversations of any length: places inside bins of the order, after the counts of the earlier bins."""
    # a text's start is enough to choose bins, and grows with the text
    binned = cut(with_bins(rows.withColumn("_head", F.left("text", F.lit(64))), [By("turn"), By("role"), By("_head")], "_bin").drop("_head"))
    inside = Window.partitionBy("conv_id", "gone", "_bin").orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER])
    head = F.struct("turn", F.left("role", F.lit(1)).alias("initial"))
    counts = binned.groupBy("conv_id", "gone", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.max_by(head, F.struct(*_ORDER)).alias("_last"))
    group = Window.partitionBy("conv_id", "gone").orderBy("_bin")
    counts = counts.select(
        "conv_id", "gone", "_bin", (F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_earlier"), F.lag("_last").over(group).alias("_carried")
    )
    local = binned.select("*", F.row_number().over(inside).alias("_place"), F.lag(head).over(inside).alias("_before"))
    placed = cut(beside_bin(local, ["conv_id", "gone"], "_bin", counts).select(
        "conv_id", "gone", *_ORDER, (F.col("_earlier") + F.col("_place")).alias("place"), F.coalesce("_before", "_carried").alias("before")
    ))
    # the first row of each role and text, by digests; places are unique in a conversation, so that no key of the join is hot
    firsts = placed.groupBy("conv_id", "gone", "role", F.sha2("text", 256).alias("d")).agg(F.min("place").alias("place"))
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("gone").alias("_g"), F.col("place").alias("_p"))
    on = placed["conv_id"].eqNullSafe(firsts["_c"]) & (placed["gone"] == firsts["_g"]) & (placed["place"] == firsts["_p"])
    return placed.join(firsts, on, "left").select(*placed.columns, F.when(F.col("_p").isNull(), F.lit(2)).otherwise(F.lit(1)).alias("seen"))


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(state: Column, cost: Column | int, letter: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def _vector(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _start(state: str) -> Column:
    return _vector(*[_state(F.lit(0 if x == state else NEVER), F.lit("")) for x in STATES])


def _with_inserts(v: Column) -> Column:
    """The cheapest ways to each state when turns may be put in here."""
    user = F.least(v["u"], _then(F.least(v["e"], v["s"], v["a"]), INSERT, "I"))
    return _vector(v["e"], v["s"], user, F.least(v["a"], _then(user, INSERT, "J")))


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _step(v: Column, row: Column) -> Column:
    """The four states after one more row."""

    def edited(w: Column) -> Column:
        gone = [_then(w[x], DELETE, "D") for x in STATES]
        more = F.when(row["truncated"], F.lit(TRUNCATED)).otherwise(F.lit(0))
        before_user = F.least(w["e"], w["s"], w["a"])
        kept = lambda initial, old: F.when(row["initial"] == initial, _then(old, more + KEEP, "K"))
        stays = _vector(
            gone[0],
            F.least(gone[1], kept("s", w["e"])),
            F.least(gone[2], kept("u", before_user), _then(before_user, more + REROLE, "R")),
            F.least(gone[3], kept("a", w["u"]), _then(w["u"], more + REROLE, "S")),
        )
        return F.when(row["blank"] | row["duplicate"], _vector(*gone)).otherwise(stays)

    return _bound(_with_inserts(v), edited)


def _best(v: Column) -> Column:
    return _bound(_with_inserts(v), lambda w: F.least(w["e"], w["a"]))


def _after(v: Column, matrix: Column) -> Column:
    """The four states after a segment; matrix has the segment's four states from each start."""
    to = lambda x: F.least(*[
        _state(v[y]["cost"] + matrix[i][x]["cost"], F.concat(v[y]["audit"], matrix[i][x]["audit"])) for i, y in enumerate(STATES)
    ])
    return _vector(*[to(x) for x in STATES])


def _facts() -> list[Column]:
    here = ~F.col("gone")
    sums = lambda c: F.sum(F.when(here, F.col(c).cast("long")).otherwise(0))
    turn = lambda f: f(F.when(here, F.col("turn"))).cast("decimal(20,0)")
    spread = turn(F.max) - turn(F.min) + 1 - sums("new_turn").cast("decimal(20,0)")
    return [F.coalesce(spread, F.lit(0)).try_cast("long").alias("gaps"), *[sums(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]]


def _lines(row: Column, piece: Column) -> Column:
    """The repaired turns that a piece of an audit, inserts and one row's edit, leaves; each ends with a line feed."""
    edit = F.right(piece, F.lit(1))
    own = F.when(edit == "K", row["role"]).when(edit == "R", F.lit("user")).when(edit == "S", F.lit("assistant"))
    put = _inserted(F.left(piece, F.length(piece) - 1))
    return F.concat(put, F.coalesce(F.concat(own, F.lit(":"), row["text"], F.lit("\n")), F.lit("")))


def _inserted(letters: Column) -> Column:
    return F.replace(F.replace(letters, F.lit("I"), F.lit("user:\n")), F.lit("J"), F.lit("assistant:\n"))


def _pieces(audit: Column) -> Column:
    return F.regexp_extract_all(audit, F.lit("[IJ]*[KRSD]"), F.lit(0))


def _last(audit: Column) -> Column:
    return F.regexp_extract(audit, "[IJ]*$", 0)


_TURN = ("place", "role", "text", "initial", "blank", "duplicate", "truncated")
OUT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal")


def _result(df: DataFrame, lines: Column) -> DataFrame:
    shown = F.translate("best.audit", "JS", "IR")
    digest = F.sha2(F.left(lines, F.greatest(F.length(lines) - 1, F.lit(0))), 256)
    return df.select(*OUT, F.col("best.cost").alias("cost"), shown.alias("audit"), digest.alias("repaired_sha256"))


def _repair_short(rows: DataFrame) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.when(~F.col("gone"), F.struct(*_TURN))))
    folded = _flagged(_placed(rows)).groupBy("conv_id").agg(*_facts(), turns.alias("turns"))
    folded = folded.withColumn("best", F.aggregate("turns", _start("e"), _step, _best))
    own = F.zip_with("turns", _pieces(F.col("best.audit")), _lines)
    return _result(folded.withColumn("lines", F.concat(F.array_join(own, ""), _inserted(_last(F.col("best.audit"))))), F.col("lines"))


def _repair_long(rows: DataFrame) -> DataFrame:
    flagged = cut(_flagged(_placed_in_bins(rows)))
    facts = flagged.groupBy("conv_id").agg(*_facts())
    here = flagged.where("NOT gone").withColumn("segment", F.floor((F.col("place") - 1) / SEGMENT))
    slim = F.struct(*[c for c in _TURN if c not in ("role", "text")])
    segments = here.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(slim)).alias("turns"))
    all_starts = F.array(*[_start(x) for x in STATES])
    segments = segments.select("conv_id", "segment", F.aggregate("turns", all_starts, lambda m, row: F.transform(m, lambda v: _step(v, row))).alias("matrix"))
    whole = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "matrix"))).alias("parts"))
    best = cut(whole.select(F.col("conv_id").alias("_c"), F.aggregate("parts", _start("e"), lambda v, p: _after(v, p["matrix"]), _best).alias("best")))
    pieces = best.select("_c", F.posexplode(_pieces(F.col("best.audit"))).alias("_p", "piece"))
    said = here.join(pieces, here["conv_id"].eqNullSafe(pieces["_c"]) & (F.col("place") == F.col("_p") + 1))
    said = said.select("conv_id", "segment", "place", _lines(F.struct("role", "text"), F.col("piece")).alias("line"))
    joined = lambda order, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda x: x[c]), "").alias(c)
    said = said.groupBy("conv_id", "segment").agg(joined("place", "line")).groupBy("conv_id").agg(joined("segment", "line"))
    said = said.select(F.col("conv_id").alias("_s"), "line")
    out = facts.join(best, facts["conv_id"].eqNullSafe(best["_c"]), "left").join(said, F.col("conv_id").eqNullSafe(F.col("_s")), "left")
    out = out.withColumn("best", F.coalesce("best", _state(F.lit(0), F.lit(""))))
    return _result(out.withColumn("lines", F.concat(F.coalesce("line", F.lit("")), _inserted(_last(F.col("best.audit"))))), F.col("lines"))


def repair(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
    rows = damage(conversations)
    counts = cut(conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > max(long, total // SHARE)).select(F.col("conv_id").alias("_id"))
    if found.isEmpty():
        return _repair_short(rows)
    marked = rows.join(F.broadcast(found.withColumn("_long", F.lit(True))), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    short = _repair_short(marked.where("_long IS NULL").drop("_long"))
    return short.unionByName(_repair_long(marked.where("_long").drop("_long")))


def oracle_sql() -> str:
    """The same rows in SQL: CRC-32 by its table, the states in a recursion over places, each as eight digits of cost and the audit."""
    add = lambda x, cost, letter: f"lpad((left({x}, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({x}, 9) || '{letter}'"
    more = "(CASE WHEN truncated THEN 1 ELSE 0 END)"
    never = "'90000000'"
    # states after inserts, as columns of a step
    user = f"least(u, {add('least(e, s, a)', INSERT, 'I')})"
    rerole = lambda old, letter: f", {add(old, f'{more} + {REROLE}', letter)}" if letter else ""
    edit = lambda state, old, letter: f"""CASE WHEN blank OR duplicate THEN {add(state, DELETE, 'D')} ELSE
        least({add(state, DELETE, 'D')}, CASE WHEN initial = '{state}' THEN {add(old, more, 'K')} ELSE {never} END{rerole(old, letter)}) END"""  # noqa: E731
    return f"""
    WITH RECURSIVE crc_bits(i, k, x) AS (
      SELECT i, 0, i::BIGINT FROM range(256) r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM crc_bits WHERE k < 8),
    crc_table AS (SELECT list(x ORDER BY i) AS crc FROM crc_bits WHERE k = 8),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc_table),
    damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
    placed AS (SELECT *, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending,
      row_number() OVER w AS place, lag(left(role, 1)) OVER w AS earlier FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    seen AS (SELECT *, ending = '' AS blank, ending <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate FROM placed),
    flagged AS (SELECT *, NOT blank AND NOT duplicate AND ending NOT IN ('.', '!', '?') AS truncated,
      coalesce(earlier || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM seen),
    walk(conv_id, place, e, s, u, a) AS (
      SELECT DISTINCT conv_id, 0::BIGINT, '00000000', {never}, {never}, {never} FROM conversations
      UNION ALL
      SELECT conv_id, place, {add('e', DELETE, 'D')}, {edit('s', 'e', '')}, {edit('u', 'least(e, s, a)', 'R')}, {edit('a', 'u', 'S')}
      FROM (SELECT conv_id, place, blank, duplicate, truncated, initial, e, s, u, least(a, {add('u', INSERT, 'J')}) AS a FROM (
        SELECT f.conv_id, f.place, blank, duplicate, truncated, initial, e, s, {user} AS u, a
        FROM walk w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1))),
    ends AS (SELECT conv_id, least(e, a, {add(user, INSERT, 'J')}) AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
    best AS (SELECT conv_id, left(best, 8)::BIGINT AS cost, substr(best, 9) AS audit FROM ends),
    pieces AS (SELECT conv_id, unnest(regexp_extract_all(audit, '[IJ]*[KRSD]')) AS piece, generate_subscripts(regexp_extract_all(audit, '[IJ]*[KRSD]'), 1) AS place FROM best),
    lines AS (SELECT p.conv_id, string_agg(replace(replace(left(piece, length(piece) - 1), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) ||
        CASE right(piece, 1) WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) WHEN 'R' THEN 'user:' || text || chr(10) ELSE 'assistant:' || text || chr(10) END,
        '' ORDER BY p.place) AS said
      FROM pieces p JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.place = p.place GROUP BY p.conv_id),
    whole AS (SELECT b.conv_id, coalesce(said, '') || replace(replace(regexp_extract(audit, '[IJ]*$'), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) AS said
      FROM best b LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM b.conv_id),
    counted AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
      count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM flagged GROUP BY conv_id)
    SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, cost, translate(audit, 'JS', 'IR') AS audit,
      sha256(left(w.said, greatest(length(w.said) - 1, 0))) AS repaired_sha256
    FROM best b JOIN whole w ON w.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""
