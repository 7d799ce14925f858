"""Fuzzy de-duplication of titles, and greedy choices that depend on order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plazalake.functions.text import normalize_url
from plazalake.operators.similar import THRESHOLD, similar_titles  # noqa: F401  the threshold is part of this interface
from plazalake.sources.shared import cut, discard


def _forms(items: DataFrame) -> DataFrame:
    """id, ord, u, t of items (id, ord, url or u, title): the normalised URL (u, if that is known) and the lower-case title, empty where there is none."""
    u = F.col("u") if "u" in items.columns else normalize_url(F.col("url"))
    return items.select("id", "ord", F.coalesce(u, F.lit("")).alias("u"), F.lower(F.coalesce("title", F.lit(""))).alias("t"))


def _numbered(*rows: DataFrame) -> tuple[DataFrame, ...]:
    """Each of rows (t, ...) with numbers of titles as t, 0 where there is none, and the similar pairs (new, old) of these."""
    found = rows[0].select("t")
    for more in rows[1:]:
        found = found.union(more.select("t"))
    number = (F.monotonically_increasing_id() + 1).alias("n")
    titles = cut(found.where("t <> ''").distinct().select("t", number), "numbers")
    known = [cut(r.join(titles, "t", "left").withColumn("t", F.coalesce("n", F.lit(0))).drop("n"), "forms") for r in rows]
    return (*known, cut(similar_titles(titles, "n"), "near"))


def _around(near: DataFrame, by_title: DataFrame) -> DataFrame:
    """new and the columns of by_title (t, ...), each the least of all titles that new is similar to."""
    kept = [c for c in by_title.columns if c != "t"]
    return near.join(by_title, near["old"] == by_title["t"]).groupBy("new").agg(*[F.min(c).alias(c) for c in kept])


def fuzzy_links(items: DataFrame) -> DataFrame:
    """id, class_id, links of each of items (id, ord, url, title).

    class_id is the first id with that normalised URL and that title; links is the number of
    other items that this one is the same as: by the URL, or by a title ratio of THRESHOLD
    at least. Copies are counted, never joined with each other; title_links has the pairs of
    different titles. An item without a URL and a title is alone.
    """
    rows, near = _numbered(cut(_forms(items), "forms"))
    both = rows.groupBy("u", "t").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "id")).alias("first"))
    by_url = both.where("u <> ''").groupBy("u").agg(F.sum("n").alias("of_url"))
    by_title = both.where("t <> 0").groupBy("t").agg(F.sum("n").alias("n"))
    of_title = near.join(by_title, near["old"] == by_title["t"]).groupBy(F.col("new").alias("t")).agg(F.sum("n").alias("of_title"))
    old = both.where("u <> '' and t <> 0").select(F.col("u").alias("_u"), F.col("t").alias("_t"), "n")
    pairs = both.where("u <> '' and t <> 0").select("u", "t").join(near, F.col("t") == F.col("new")).select("u", "t", "old")
    twice = pairs.join(old, (F.col("u") == F.col("_u")) & (F.col("old") == F.col("_t"))).groupBy("u", "t").agg(F.sum("n").alias("twice"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero("of_url") + zero("of_title") - zero("twice") - F.when((F.col("u") != "") | (F.col("t") != 0), 1).otherwise(0)
    counted = both.join(by_url, "u", "left").join(of_title, "t", "left").join(twice, ["u", "t"], "left").select("u", "t", F.col("first.id").alias("_first"), total.alias("links"))
    alone = (F.col("u") == "") & (F.col("t") == 0)
    return rows.join(counted, ["u", "t"]).select("id", F.when(alone, F.col("id")).otherwise(F.col("_first")).alias("class_id"), "links")


def title_links(items: DataFrame) -> DataFrame:
    """a, b: of each two different titles of a ratio of THRESHOLD at least (a's against b's) the first ids that have them."""
    rows = _forms(items).where("t <> ''")
    first = cut(rows.groupBy("t").agg(F.min(F.struct("ord", "id"))["id"].alias("id")), "first")
    return similar_titles(first, "id", itself=False).toDF("a", "b")


#: Rounds over groups before what is left is decided over pairs, and pairs for each undecided item that this may take.
GROUP_ROUNDS, PAIRS = 6, 32
#: Open items and pairs of their titles, together, that one task decides.
LAST = 1 << 16


def _settle(left: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, kept of items (id) of which one goes if it has a pair (r, p) with p kept.

    An item without pairs is kept; known states are put in; an item that depends on one
    other alone is its opposite, so whoever depends on it can look to that other instead.
    So chains halve in every round, whatever their order.
    """
    todo, lits, done = left.select("id"), cut(pairs.select("r", "p", F.lit(False).alias("neg")).distinct(), "pairs"), []
    before = None
    while True:
        free = todo.join(lits.select(F.col("r").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("kept"))
        torn = lits.groupBy("r", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("r").alias("id"), F.lit(False).alias("kept"))
        known = free.union(torn.distinct())
        if before is not None:
            known = known.union(before)
        seen = lits.join(known.select(F.col("id").alias("p"), "kept"), "p", "left").withColumn("v", F.col("kept") != F.col("neg"))
        hit = seen.groupBy("r").agg(F.coalesce(F.bool_or("v"), F.lit(False)).alias("hit")).where("hit").select(F.col("r").alias("id"), F.lit(False).alias("kept"))
        now = cut(free.union(torn.distinct()).union(hit).groupBy("id").agg(F.bool_and("kept").alias("kept")), "settled")
        done.append(now)
        rest = seen.where("v is null").select("r", "p", "neg").join(now.select(F.col("id").alias("r")), "r", "left_anti")
        single = rest.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.first("p").alias("q"), F.first("neg").alias("m")).where("n = 1").select(F.col("r").alias("p"), "q", "m")
        jumped = rest.join(single, "p", "left").select("r", F.coalesce("q", "p").alias("p"), F.when(F.col("q").isNull(), F.col("neg")).otherwise(F.col("neg") == F.col("m")).alias("neg"))
        following, todo_next = cut(jumped.distinct(), "pairs"), cut(todo.join(now, "id", "left_anti"), "todo")
        discard(lits)
        if len(done) > 1:
            discard(todo)
        lits, todo, before = following, todo_next, now
        if not todo.take(1):
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _in_turn(left: DataFrame, near: DataFrame) -> DataFrame:
    """Those of left (id, o, u, t) that are kept, decided one after the other in one task: for a bounded rest."""

    def decide(items, pairs):
        like, where, known = {}, {}, {}
        for new, old in zip(pairs.column("new").to_pylist(), pairs.column("old").to_pylist(), strict=True):
            like.setdefault(new, []).append(old)
        turn, urls, titles = (items.column(c).to_pylist() for c in ("_turn", "u", "t"))
        kept = []
        for at in sorted(range(len(turn)), key=turn.__getitem__):
            o, u, t = turn[at], urls[at], titles[at]
            if (u and where.get(u, o) < o) or any(known.get(old, o) < o for old in like.get(t, ())):
                continue
            kept.append(at)
            where.setdefault(u, o)
            known.setdefault(t, o)
        return items.take(pa.array(kept, pa.int64())).drop_columns(["_turn"])

    one = F.lit(0).alias("_one")
    turns = left.withColumn("_turn", F.rank().over(Window.orderBy("o")))
    return turns.groupBy(one).cogroup(near.groupBy(one)).applyInArrow(decide, left.schema)


def _choose(reps: DataFrame, near: DataFrame) -> DataFrame:
    """id, o, u, t of those of reps (id, o, u, t: any key of a title; one of none isn't in near) that are kept, going by o: one goes if an earlier one that is kept is the same.

    Each round works on what is open by URL and by title, never on pairs of items: the
    earliest among all that are the same as it stays, and who has one that stays before it
    goes. So copies, stars and cliques take one round, and only open items and the pairs of
    their titles are read again. At most LAST of these are decided in order by one task; of
    more, what is left after GROUP_ROUNDS, chains in order, is decided over pairs, if those
    aren't many more than the items.
    """
    found, left, rounds = None, reps, 0
    before = lambda c: F.coalesce(F.col(c) < F.col("o"), F.lit(False))
    least = lambda rows: (
        _around(near, rows.groupBy("t").agg(F.min("o").alias("mt"))).withColumnRenamed("new", "t"),
        rows.where("u <> ''").groupBy("u").agg(F.min("o").alias("mu")),
    )
    while True:
        rounds += 1
        by_title, by_url = least(left)
        first = ~before("mt") & ~before("mu")
        state = cut(left.join(by_title, "t", "left").join(by_url, "u", "left").select("id", "o", "u", "t", first.alias("kept")), "state")
        kept, rest = state.where("kept").drop("kept"), state.where("not kept").drop("kept")
        by_title, by_url = least(kept)
        rest = cut(rest.join(by_title, "t", "left").join(by_url, "u", "left").where(~before("mt") & ~before("mu")).select("id", "o", "u", "t"), "open")
        found = kept if found is None else found.unionByName(kept)
        if rounds > 1:
            discard(left)
        n = rest.count()
        if not n:
            return found
        titles = rest.select("t").distinct()
        of_open = cut(near.join(titles.withColumnRenamed("t", "new"), "new", "left_semi").join(titles.withColumnRenamed("t", "old"), "old", "left_semi").select("new", "old"), "near")
        if rounds > 1:
            discard(near)
        near = of_open
        if n + near.count() <= LAST:
            return found.unionByName(_in_turn(rest, near))
        if rounds >= GROUP_ROUNDS:
            x, y = rest.alias("x"), rest.alias("y")
            of_title = near.join(x.groupBy("t").agg(F.count(F.lit(1)).alias("a")), F.col("new") == F.col("t")).drop("t").join(y.groupBy("t").agg(F.count(F.lit(1)).alias("b")), F.col("old") == F.col("t"))
            of_url = rest.where("u <> ''").groupBy("u").agg(F.count(F.lit(1)).cast("double").alias("n"))
            many = (of_title.agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0) + (of_url.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0)
            if many <= PAIRS * n:
                earlier = F.col("y.o") < F.col("x.o")
                by_url = x.join(y, (F.col("x.u") == F.col("y.u")) & (F.col("x.u") != "") & earlier)
                by_title = x.join(near, F.col("x.t") == F.col("new")).join(y, (F.col("old") == F.col("y.t")) & earlier)
                pair = [F.col("x.id").alias("r"), F.col("y.id").alias("p")]
                chosen = _settle(rest, by_url.select(*pair).union(by_title.select(*pair))).where("kept").select("id")
                return found.unionByName(rest.join(chosen, "id", "left_semi"))
        left = rest


def greedy_dedup(items: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """id, kept, dup_of of items (id, ord, url, title): in order of ord (then id) an item goes if it is the same
    as one of history (the first in its order), else as one kept before (the first of those).

    Items of one URL and one title share the fate of their first; between those that are left
    the choice is made in rounds of joins, never in one task.
    """
    rows = cut(_forms(items).withColumn("o", F.struct("ord", "id")).drop("ord"), "forms")
    past = None if history is None else cut(_forms(history), "history")
    if past is None:
        rows, near = _numbered(rows)
    else:
        rows, past, near = _numbered(rows, past)
    alone = (F.col("u") == "") & (F.col("t") == 0)
    whole = rows.where(~alone)
    reps = whole.groupBy("u", "t").agg(F.min("o").alias("o"))
    kind = items.schema["id"].dataType
    if past is None:
        reps = reps.withColumn("past", F.lit(None).cast(kind))
    else:
        order = F.struct("ord", "id")
        by_title = _around(near, past.where("t <> 0").groupBy("t").agg(F.min(order).alias("pt"))).withColumnRenamed("new", "t")
        by_url = past.where("u <> ''").groupBy("u").agg(F.min(order).alias("pu"))
        reps = reps.join(by_title, "t", "left").join(by_url, "u", "left").withColumn("past", F.least("pt", "pu")["id"].cast(kind)).drop("pt", "pu")
    reps = cut(reps.withColumn("id", F.col("o.id")), "classes")
    kept = cut(_choose(reps.where("past is null").select("id", "o", "u", "t"), near), "kept")
    by_title = _around(near, kept.where("t <> 0").groupBy("t").agg(F.min("o").alias("kt"))).withColumnRenamed("new", "t")
    by_url = kept.where("u <> ''").groupBy("u").agg(F.min("o").alias("ku"))
    into = reps.join(by_title, "t", "left").join(by_url, "u", "left").select("u", "t", F.coalesce("past", F.least("kt", "ku")["id"]).alias("into"))
    found = whole.join(into, ["u", "t"]).select("id", (F.col("into") == F.col("id")).alias("kept"), F.when(F.col("into") != F.col("id"), F.col("into")).alias("dup_of"))
    if past is not None:  # an id of history may be that of an item
        hit = reps.where("past is not null").select("u", "t", F.lit(True).alias("_past"))
        found = whole.join(into, ["u", "t"]).join(hit, ["u", "t"], "left")
        stays = F.col("_past").isNull() & (F.col("into") == F.col("id"))
        found = found.select("id", stays.alias("kept"), F.when(~stays, F.col("into")).alias("dup_of"))
    return found.unionByName(rows.where(alone).select("id", F.lit(True).alias("kept"), F.lit(None).cast(kind).alias("dup_of")))


def pool_upsert(items: DataFrame, pool: DataFrame, history: DataFrame, since: str) -> DataFrame:
    """id, action of new items (id, ord, url, title) in order: refresh, drop or insert; items without a URL or title go.

    A URL of the pool, however old, or of an item inserted before is refreshed; what is the same as a row
    of the pool first seen from `since` on, of any status, or as one of history, or as an item inserted
    before is dropped; the rest is inserted. pool and history have id, ord, url, title, the pool first_seen too.
    """
    u = normalize_url(F.col("url")).alias("u")
    whole = items.where(F.coalesce(F.col("title").rlike(r"(?U)\S"), F.lit(False))).select("id", "ord", "title", u).where("u <> ''")
    since = F.coalesce(F.col("first_seen") >= F.expr(f"timestamp_ntz '{since}'"), F.lit(False))
    pooled = cut(pool.select("id", "ord", "title", u, since.alias("recent")), "pooled")
    urls = pooled.select("u").distinct().withColumn("known", F.lit(True))
    whole = cut(whole.join(urls, "u", "left").withColumn("known", F.col("known").isNotNull()), "whole")
    known, rest = whole.where("known"), whole.where("not known")
    older = lambda rows, part: rows.select("id", F.struct(F.lit(part).alias("part"), F.col("ord").cast("long").alias("at")).alias("ord"), "title", "u")
    past = older(pooled.where("recent"), 0).unionByName(older(history.select("id", "ord", "title", u), 1))
    found = rest.select("id", "ord", "u").join(greedy_dedup(rest.select("id", "ord", "title", "u"), past).select("id", "kept"), "id")
    first = found.where("kept").groupBy("u").agg(F.min("ord").alias("_first"))
    action = F.when(F.col("kept"), "insert").when(F.col("_first") < F.col("ord"), "refresh").otherwise("drop")
    return known.select("id", F.lit("refresh").alias("action")).union(found.join(first, "u", "left").select("id", action.alias("action")))


def merge_news(items: DataFrame) -> DataFrame:
    """Items (id, ord, url, title, day, summary) over days merged with the first that is the same, best first.

    id, title, url of that first, days (occurrences), first_day, summaries: its own, empty if
    it has none, then the others that aren't empty, each once, in order.
    """
    items = cut(items.select("id", "ord", "url", "title", "day", "summary"), "items")
    found = greedy_dedup(items).select("id", F.coalesce("dup_of", "id").alias("into"))
    rows = items.join(found, "id").withColumns({"o": F.struct("ord", "id"), "summary": F.coalesce("summary", F.lit(""))})
    each = rows.groupBy("into", "summary").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "day")).alias("d"))
    merged = each.groupBy("into").agg(F.sum("n").alias("days"), F.min("d")["day"].alias("first_day"), F.array_sort(F.collect_list(F.struct("o", "summary"))).alias("_all"))
    texts = F.transform("_all", lambda x: x["summary"])
    summaries = F.filter(texts, lambda x, i: (i == 0) | (x != ""))
    head = items.select(F.col("id").alias("into"), "title", "url")
    return merged.join(head, "into").select(F.col("into").alias("id"), "title", "url", "days", "first_day", summaries.alias("summaries")).orderBy(F.desc("days"), "first_day", "id")
