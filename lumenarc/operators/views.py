"""Small relational operators over papers, answers and runs: filters by presence, counts, rankings, merges, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.text import col


def rows_with(rows: DataFrame, key: str, *values) -> DataFrame:
    """Point lookup: the rows of these keys; the filter reaches the scan."""
    return rows.where(F.col(key).isin(list(values)))


def first_rows(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows in an order, as iteration with a limit gives them."""
    return rows.orderBy(*order).limit(limit)


def missing_from(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Keys of rows that others lack."""
    return rows.select(key).distinct().join(others.select(key), key, "left_anti")


def without_any(rows: DataFrame, *others: tuple[DataFrame, str]) -> DataFrame:
    """Rows that occur in none of the others, each by its key."""
    for other, key in others:
        rows = rows.join(other.select(key), key, "left_anti")
    return rows


def pending_ids(rows: DataFrame, key: str, done: DataFrame, failed: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Keys still to be worked on, in order: neither done nor (where given) failed, `limit` of them at most."""
    left = without_any(rows.select(key), (done, key), *([(failed, key)] if failed is not None else []))
    return left.orderBy(key).limit(limit) if limit is not None else left


def split_parents(rows: DataFrame, parent: str, child: str, name: str = "paths") -> DataFrame:
    """Parents whose rows lead to more than one child."""
    return rows.groupBy(parent).agg(F.count_distinct(child).alias(name)).where(F.col(name) > 1)


def missing_list(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose list is null or empty."""
    return rows.where(F.coalesce(F.size(name), F.lit(0)) <= 0)


def enrich_pairs(pairs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Pairs with the columns of one side's item; pairs of unknown items go."""
    return pairs.join(items, key)


def date_changes(seen: DataFrame, now: DataFrame, key: str, held: str, stamp: str, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """key, change: new, deleted, modified (more than a day newer than the date held as text) or unchanged; a date that can't be read changes nothing."""
    both = seen.withColumn("__i", F.lit(True)).join(now.withColumn("__j", F.lit(True)), key, "full_outer")
    newer = F.col(stamp).cast("timestamp") > F.try_to_timestamp(held, F.lit(pattern)) + F.expr("INTERVAL 1 DAY")
    change = F.when(F.col("__i").isNull(), "new").when(F.col("__j").isNull(), "deleted").when(F.coalesce(newer, F.lit(False)), "modified").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def widest_pairs(left: DataFrame, right: DataFrame, group: str, a: str, b: str, keys: list[str], k: int) -> DataFrame:
    """The k pairs of a group's rows that differ most in a and b: `score`. Only the k largest and smallest of either side can be among them, so only they meet."""

    def ends(rows, value, key):
        place = lambda order: F.row_number().over(Window.partitionBy(group).orderBy(order, key))
        low, high = (rows.withColumn("__n", place(o)).where(F.col("__n") <= k).drop("__n") for o in (F.col(value).asc(), F.col(value).desc()))
        return low.unionByName(high).distinct()

    pairs = ends(left, a, keys[0]).join(ends(right, b, keys[1]), group)
    return pairs.withColumn("score", F.round(F.abs(F.col(a) - F.col(b)), 2)).orderBy(F.col("score").desc(), *keys).limit(k)


def first_reason(**conditions: Column) -> Column:
    """The name of the first condition that holds; null if none does."""
    out = None
    for name, ok in conditions.items():
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out


def related_counts(rows: DataFrame, related: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """rows with, for each name, how many related rows meet its condition; 0 where there are none."""
    counts = related.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    return rows.join(counts, key, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in conditions})


def kept_by(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key others hold."""
    return rows.join(others.select(key), key, "left_semi")


def sort_results(rows: DataFrame, by: str = "year", limit: int | None = None) -> DataFrame:
    """By year (newest first, unknown last) or title; ties by title, then place."""
    order = {"year": [F.col("year").desc_nulls_last(), F.lower("title"), "pos"], "title": [F.lower("title"), "pos"]}[by]
    out = rows.orderBy(*order)
    return out.limit(limit) if limit else out


def richest_papers(papers: DataFrame, k: int) -> DataFrame:
    """The k papers with most lines, then characters, then the latest: candidates for a sample."""
    some = papers.where("text is not null").select("paper_id", F.size(F.split("text", "\n")).alias("lines"), F.length("text").alias("chars"), F.coalesce("year", F.lit(0)).alias("y"))
    return first_rows(some, [F.col(c).desc() for c in ("lines", "chars", "y", "paper_id")], k)


def newest(rows: DataFrame, when: str, key: str, k: int) -> DataFrame:
    """The k latest rows; unknown dates last, ties by key."""
    return first_rows(rows, [F.col(when).desc_nulls_last(), key], k)


def plan_groups(rows: DataFrame, group: str, order: str, key: str, k: int = 5) -> DataFrame:
    """The first k keys of each group with the group's size and how many more it has."""
    w = Window.partitionBy(group)
    ranked = rows.select(group, key, F.row_number().over(w.orderBy(order)).cast("long").alias("n"), F.count("*").over(w).alias("size"))
    return ranked.where(F.col("n") <= k).withColumn("more", F.greatest(F.col("size") - k, F.lit(0)).cast("long"))


def section_counts(rows: DataFrame, section: str, key: str, newest_first: bool = False, k: int = 10) -> DataFrame:
    """section, key, n, place: the k commonest values (or the k greatest); null values go."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    order = [F.col("key").desc()] if newest_first else [F.col("n").desc(), "key"]
    top = counts.orderBy(*order).limit(k)
    return top.select(F.lit(section).alias("section"), "key", "n", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # k rows


def counts_of_kinds(rows: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """n for each kind (a small table), 0 for those without rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return kinds.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def corpus_range(papers: DataFrame) -> DataFrame:
    """How many collections and types there are, and the first and last year."""
    return papers.agg(F.count_distinct("collection").alias("collections"), F.count_distinct("item_type").alias("types"), F.min("year").alias("first"), F.max("year").alias("last"))


def counts_by_each(rows: DataFrame, **keys: str) -> DataFrame:
    """key (label:value), n for several columns at once, by grouping sets."""
    columns = list(keys.values())
    g = rows.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"))
    return g.select(F.coalesce(*[F.concat(F.lit(f"{label}:"), c) for label, c in keys.items()]).alias("key"), "n")


def confidence_bands(rows: DataFrame, key: str, confidence: Column) -> DataFrame:
    """n of each key in the bands high (0.8), medium (0.5) and low."""
    band = F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")
    return rows.groupBy(key, band.alias("band")).agg(F.count("*").alias("n"))


def group_heads(rows: DataFrame, group: Column | str, key: str, k: int = 5, size: str = "n", heads: str = "first_ids") -> DataFrame:
    """Size of each group and its k smallest keys, joined."""
    place = F.row_number().over(Window.partitionBy("__g").orderBy(key))
    ranked = rows.select(col(group).alias("__g"), key).withColumn("__n", place)
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__n") <= k, F.col(key)))), lambda x: x.cast("string")), ",")
    return ranked.groupBy("__g").agg(F.count("*").alias(size), first.alias(heads))


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """group, i, mean: the mean vector of each group, a row for each place."""
    e = vectors.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    return e.groupBy(group, "i").agg(F.avg("x").alias("mean"))


def field_rates(answers: DataFrame, field: str = "dimension", value: str = "value") -> DataFrame:
    """Of each field: rows, answered rows and their share."""
    return answers.groupBy(field).agg(F.count("*").alias("total"), F.count(value).alias("given"), (F.count(value) / F.count("*")).alias("rate"))


def run_statistics(runs: DataFrame, group: str, success: Column, cost: str) -> DataFrame:
    """Runs, successes, their rate and total cost of each group."""
    ok = F.count_if(success)
    return runs.groupBy(group).agg(F.count("*").alias("runs"), ok.alias("done"), F.try_divide(ok, F.count("*")).alias("rate"), F.sum(cost).alias("cost"))


def batch_summary(runs: DataFrame, group: str, confidence: str, seconds: str) -> DataFrame:
    return runs.groupBy(group).agg(F.count("*").alias("runs"), F.avg(confidence).alias("confidence"), F.avg(seconds).alias("seconds"))


def find_patterns(messages: DataFrame, pattern: str, session: str, text: str = "text") -> DataFrame:
    """k, sessions, hits: what a pattern's first group finds in lower-case texts, and in how many sessions."""
    hits = messages.where(F.col(text).isNotNull()).select(session, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))).alias("k"))
    return hits.groupBy("k").agg(F.count_distinct(session).alias("sessions"), F.count("*").alias("hits"))


def compare_answers(one: DataFrame, two: DataFrame, keys: list[str], dimension: str = "dimension") -> DataFrame:
    """one (keys, a), two (keys, b): of each dimension how many are answered by both, one or neither side, and where a is longer."""
    both = one.join(two, keys, "full_outer")
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.groupBy(dimension).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"), F.count_if(F.length("a") > F.length("b")).alias("a_longer"))


def rank_within(rows: DataFrame, group: str | list[str], order: list, k: int | None = None, name: str = "rank") -> DataFrame:
    """1-based rank in each group, the first k of each if given; the cut comes before the exchange."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    out = rows.withColumn(name, F.row_number().over(w).cast("long"))
    return out.where(F.col(name) <= k) if k else out


def rarity(*keys: str) -> Column:
    """Mean over the keys of 1 / (rows that share the key)."""
    return sum((1 / F.count("*").over(Window.partitionBy(k)) for k in keys), F.lit(0.0)) / len(keys)


def context_window(rows: DataFrame, group: str, order: str, before: int, after: int, text: str = "text") -> DataFrame:
    """rows with the characters and number of rows from `before` rows ahead to `after` behind."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-before, after)
    return rows.withColumns({"context_chars": F.sum(F.length(text)).over(w).cast("long"), "rows_seen": F.count("*").over(w)})


def first_source(key: str, *sources: DataFrame) -> DataFrame:
    """key, first: the number of the first source that holds the key."""
    out = None
    for i, s in enumerate(sources):
        part = s.select(key, F.lit(i).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.min("p").alias("first"))


def merge_proposals(rows: DataFrame, key: str, confidence: str, text: Column, keep: str, source: str) -> DataFrame:
    """Of each key: the greatest confidence, what is kept of the longest proposal, and how many sources proposed it."""
    return rows.groupBy(key).agg(F.max(confidence).alias("confidence"), F.max_by(keep, F.struct(text, keep)).alias("longest"), F.count_distinct(source).alias("sources"))


def tagged_union(**sources: DataFrame) -> DataFrame:
    """All rows with the name of their source."""
    out = None
    for name, s in sources.items():
        part = s.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def merged_lists(rows: DataFrame, key: str, name: str, separator: str = "|") -> DataFrame:
    """Of each key the distinct members of all its lists, sorted and joined."""
    each = rows.select(key, F.explode(name).alias("c")).distinct()
    return each.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("c")), separator).alias(name))


def key_set(one: DataFrame, two: DataFrame, how: str) -> DataFrame:
    """Difference, intersection or union of two key columns, each key once."""
    return {"minus": one.subtract, "and": one.intersect, "or": lambda other: one.union(other).distinct()}[how](two)


def by_precedence(*sources: tuple[Column, str, float]) -> Column:
    """source, confidence of the first source whose condition holds; else none, 0."""
    found = [F.when(ok, F.struct(F.lit(s).alias("source"), F.lit(c).alias("confidence"))) for ok, s, c in sources]
    return F.coalesce(*found, F.struct(F.lit("none").alias("source"), F.lit(0.0).alias("confidence")))


def resolve_targets(wanted: DataFrame, current: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """key, state: current, deleted or unmatched."""
    j = wanted.select(key).join(current.select(key).distinct().withColumn("__a", F.lit(True)), key, "left").join(deleted.select(key).distinct().withColumn("__b", F.lit(True)), key, "left")
    return j.select(key, F.when(F.col("__a"), "current").when(F.col("__b"), "deleted").otherwise("unmatched").alias("state"))


def ask_again(answers: DataFrame) -> DataFrame:
    """paper_id, ask_again: dimensions that no provider answered, joined."""
    have = answers.groupBy("paper_id", "dimension").agg(F.count("value").alias("n"))
    return have.where("n = 0").groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("dimension")), ",").alias("ask_again"))


def reply_questions(reply: Column | str) -> Column:
    """The questions of a JSON reply: those that end like one."""
    return F.filter(F.from_json(reply, "questions array<string>")["questions"], lambda q: F.endswith(q, F.lit("?")))


def memory_rows(messages: DataFrame, session: str, turn: str) -> DataFrame:
    """name, kind: an entity for each session and a relation for each of its turns."""
    name = F.concat(F.lit("session"), session)
    entities = messages.select(name.alias("name"), F.lit("session").alias("kind")).distinct()
    return entities.unionByName(messages.select(F.concat(name, F.lit("->"), F.col(turn).cast("string")).alias("name"), F.lit("relation").alias("kind")))


def call_costs(calls: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """cost, calls of each model. prices (model, inp, out): a small table of prices for a thousand tokens."""
    cost = F.col(tokens_in) * F.col("inp") / 1000 + F.col(tokens_out) * F.col("out") / 1000
    return calls.join(F.broadcast(prices), model).groupBy(model).agg(F.sum(cost).alias("cost"), F.count("*").alias("calls"))


def unwrapped(extraction: Column | str, field: str) -> Column:
    """A field of the nested record, else the flat column of that name."""
    return F.coalesce(col(extraction)[field], F.col(field))


def metadata_texts() -> dict[str, Column]:
    """Chunk metadata as scalars: null becomes the empty text, lists are joined."""
    return {"year": F.coalesce(F.col("year").cast("string"), F.lit("")), "collections": F.array_join("collections", ","), "doi": F.coalesce("doi", F.lit(""))}


def index_projection(papers: DataFrame) -> DataFrame:
    return papers.select("paper_id", "title", "year", "doi", "item_type", F.array_join("collections", "; ").alias("collections"))


def paper_briefs(papers: DataFrame, abstract: int = 700, title: int = 48) -> DataFrame:
    """Papers as a prompt sees them: abstract and title cut to a length."""
    return papers.select("paper_id", F.substring("text", 1, abstract).alias("abstract"), F.substring("title", 1, title).alias("title"))


def parsed_metadata(year: Column | str, collections: Column | str) -> dict[str, Column]:
    """Stored texts as values again: a year if it is a number, the collections' list without blanks."""
    names = F.filter(F.transform(F.split(col(collections), ","), lambda x: F.trim(x)), lambda x: x != "")
    return {"year": F.when(col(year).rlike("^[0-9]+$"), col(year).cast("int")), "collections": names}


def answers_by_section(answers: DataFrame, section: Column) -> DataFrame:
    """paper_id, section, fields, names: which dimensions of a section are answered."""
    given = answers.where("value is not null").withColumn("section", section)
    return given.groupBy("paper_id", "section").agg(F.count("*").alias("fields"), F.array_join(F.array_sort(F.collect_list("dimension")), ",").alias("names"))


def flat_to_dimensions(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, dimension, value: a flat record as one row for each answer."""
    return records.unpivot(key, fields, "dimension", "value").where("value is not null")


def proposal_id(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clamped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
