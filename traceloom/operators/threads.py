"""Related activities linked by shared words that sit close, or install and use."""

from pyspark.sql import DataFrame, functions as F

from .. import functions as X
from .. import vocab as V
from ..session import written
from .activity import label
from .ordering import first_rows, number_rows, previous_value
from .scoring import has_signal


def group_tokens(groups: DataFrame) -> DataFrame:
    """One row per (activity, distinctive word)."""
    named = groups.filter((F.coalesce("full_command_line", F.lit("")) != "")
                          | (F.coalesce("executable", F.lit("")) != ""))
    return named.select("investigation_id", "group_id", F.explode(X.distinctive_tokens(
        "full_command_line", "executable", "process_name")).alias("token"))


def rare_tokens(tokens: DataFrame, *, min_df=V.TOKEN_MIN_DF, max_df: int | None = None) -> DataFrame:
    """Words that occur in at least ``min_df`` activities of an investigation, and in ``max_df`` at most if it is given.

    With ``max_df`` a word in more activities counts as vocabulary and relates nothing.
    """
    keys = ["investigation_id", "token"]
    kept = tokens.groupBy(*keys).agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    if max_df is not None:
        kept = kept.filter(F.col("df") <= max_df)
    return tokens.join(kept, keys)


def candidate_pairs(rare: DataFrame) -> DataFrame:
    """All pairs of activities per shared word, through the word's posting list.

    For words of a small ``max_df``, as the pairs of a word grow with its square; :func:`chained` links the
    same activities for words of any frequency.
    """
    posting = rare.groupBy("investigation_id", "token").agg(
        F.array_sort(F.collect_list("group_id")).alias("ids"))
    left = posting.select("investigation_id", "token", "ids", F.posexplode("ids").alias("i", "a"))
    pairs = left.select("investigation_id", "token", "a", F.explode(F.slice(
        "ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    return pairs.filter("a <> b")


def history_positions(records: DataFrame) -> DataFrame:
    """Line numbers of each activity per history file, bucketed for neighbour search."""
    rows = records.select(
        "group_id", "endpoint_id", X.history_file("source_record_id").alias("file"),
        X.history_line("source_record_id").alias("line")).filter("line IS NOT NULL")
    return rows.distinct()


def near_in_history(pairs: DataFrame, records: DataFrame, *,
                    lines=V.ADJACENT_LINES) -> DataFrame:
    """Pairs with two lines of one history file at most ``lines`` apart.

    Lines fall in buckets of that width; a neighbour is in the same bucket or the
    next, so an activity with many lines is matched bucket by bucket.
    """
    width = lines + 1
    spots = history_positions(records).withColumn("slot", F.floor(F.col("line") / width))
    kept = spots.groupBy("group_id", "endpoint_id", "file", "slot").agg(
        F.min("line").alias("low"), F.max("line").alias("high"))
    distinct = pairs.select("investigation_id", "a", "b").distinct()
    ours = kept.select(F.col("group_id").alias("a"), F.col("endpoint_id").alias("ea"),
                       F.col("file").alias("fa"), F.col("slot").alias("sa"),
                       F.col("low").alias("la"), F.col("high").alias("ha"))
    reach = ours.withColumn("slot", F.explode(F.array(
        F.col("sa") - 1, F.col("sa"), F.col("sa") + 1)))
    theirs = kept.select(F.col("group_id").alias("b"), F.col("endpoint_id").alias("eb"),
                         F.col("file").alias("fb"), "slot", F.col("low").alias("lb"),
                         F.col("high").alias("hb"))
    joined = distinct.join(reach, "a").join(theirs, ["b", "slot"]).filter(
        "ea = eb AND fa = fb")
    # Same bucket is always near; across buckets the facing ends decide.
    close = (F.when(F.col("slot") == F.col("sa"), True)
             .when(F.col("slot") > F.col("sa"), F.col("lb") - F.col("ha") <= lines)
             .otherwise(F.col("la") - F.col("hb") <= lines))
    return joined.filter(close).select("investigation_id", "a", "b").distinct()


def linked(pairs: DataFrame, groups: DataFrame, records: DataFrame) -> DataFrame:
    """Edges with a reason: one installs the shared word, or the two sit close together."""
    facts = groups.select(
        "group_id", F.lower(F.coalesce("full_command_line", F.lit(""))).alias("text"),
        X.installs_something("full_command_line").alias("installs"), "first_seen", "last_seen")
    left = facts.select(*[F.col(c).alias(f"a_{c}") for c in facts.columns])
    right = facts.select(*[F.col(c).alias(f"b_{c}") for c in facts.columns])
    both = pairs.join(left, pairs["a"] == left["a_group_id"]).join(
        right, pairs["b"] == right["b_group_id"])
    installs = ((F.col("a_installs") & F.contains("a_text", F.col("token")))
                | (F.col("b_installs") & F.contains("b_text", F.col("token"))))

    def within(x, y):
        return F.abs(F.unix_micros(x) - F.unix_micros(y)) <= V.ADJACENT_SECONDS * 1_000_000
    timely = F.coalesce(
        within("a_first_seen", "b_first_seen") | within("a_first_seen", "b_last_seen")
        | within("a_last_seen", "b_first_seen") | within("a_last_seen", "b_last_seen"),
        F.lit(False))
    close = near_in_history(pairs, records).withColumn("_close", F.lit(True))
    tested = both.withColumn("_installs", installs).withColumn("_timely", timely).select(
        "investigation_id", "a", "b", "token", "_installs", "_timely").join(
            close, ["investigation_id", "a", "b"], "left")
    kept = tested.filter(F.col("_installs") | F.col("_timely") | F.col("_close"))
    reason = F.when(F.col("_installs"), F.concat(
        F.lit("one installs or fetches '"), "token", F.lit("' and another uses it"))).otherwise(
        F.concat(F.lit("recorded close together and both reference '"), "token", F.lit("'")))
    return kept.groupBy("investigation_id", "a", "b").agg(F.min(reason).alias("reason"))


def chained(tokens: DataFrame, groups: DataFrame, records: DataFrame, *, lines=V.ADJACENT_LINES,
            seconds=V.ADJACENT_SECONDS) -> DataFrame:
    """Links ``(investigation_id, a, b, reason)`` that hang together what :func:`linked` does over all pairs.

    Per word, activities lie along each history file by line and along time by their first and last record. Only
    neighbours on these lines are linked, and each activity with the first that installs the word: two that are
    close have only closer ones between them. So a word in n activities makes of the order of n links, not n squared,
    and no word is too frequent. Per component and word the reasons are those of all pairs.
    """
    word = ["investigation_id", "token"]
    facts = groups.select(
        "group_id", F.lower(F.coalesce("full_command_line", F.lit(""))).alias("_text"),
        X.installs_something("full_command_line").alias("_installs"), "first_seen", "last_seen")
    used = written(tokens.select(*word, "group_id").distinct().join(facts, "group_id").select(
        *word, "group_id", (F.col("_installs") & F.contains("_text", F.col("token"))).alias("installs"),
        "first_seen", "last_seen"))

    def neighbours(points, group, at, within):
        """Links of points that follow one another along ``at`` at most ``within`` apart."""
        beside = previous_value(points, group, [F.col(at), F.col("group_id")], F.struct("group_id", at), "_before")
        near = (F.col(at) - F.col(f"_before.{at}") <= within) & (F.col("_before.group_id") != F.col("group_id"))
        return beside.filter(near).select(*word, F.col("_before.group_id").alias("x"), F.col("group_id").alias("y"),
                                          F.lit(False).alias("installs"))

    first = used.filter("installs").groupBy(*word).agg(F.min("group_id").alias("x"))
    installed = used.join(first, word).filter("group_id <> x").select(
        *word, "x", F.col("group_id").alias("y"), F.lit(True).alias("installs"))
    moments = used.select(*word, "group_id", F.explode(F.array_distinct(F.array(
        F.unix_micros("first_seen"), F.unix_micros("last_seen")))).alias("moment")).filter("moment IS NOT NULL")
    spots = used.select(*word, "group_id").join(history_positions(records), "group_id").select(
        *word, "group_id", "endpoint_id", "file", "line")
    links = installed.unionByName(neighbours(moments, word, "moment", seconds * 1_000_000)).unionByName(
        neighbours(spots, [*word, "endpoint_id", "file"], "line", lines))
    reason = F.when(F.col("installs"), F.concat(
        F.lit("one installs or fetches '"), "token", F.lit("' and another uses it"))).otherwise(
        F.concat(F.lit("recorded close together and both reference '"), "token", F.lit("'")))
    return links.groupBy("investigation_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.min(reason).alias("reason"))


def connected(edges: DataFrame) -> DataFrame:
    """``(investigation_id, node, root)`` with the least id of each component as root.

    Each round moves every node to the least id next to it, twice, and then
    merges nodes that met: what is left of the graph shrinks by half at least,
    so rounds grow with the logarithm of its size and come to an end. Tables are
    written every round, so a lost executor repeats one round only.
    """
    key = ["investigation_id"]
    links = written(edges.select(*key, "a", "b").unionByName(
        edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = links.select(*key, F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    while not links.isEmpty():
        step = links.groupBy(*key, "a").agg(F.least("a", F.min("b")).alias("to"))
        further = step.select(*key, F.col("a").alias("to"), F.col("to").alias("to2"))
        moved = written(step.join(further, [*key, "to"]).select(*key, "a", "to2"))
        labels = written(labels.join(moved.withColumnRenamed("a", "root"), [*key, "root"], "left")
                         .select(*key, "node", F.coalesce("to2", "root").alias("root")))
        left = moved.select(*key, "a", F.col("to2").alias("na"))
        right = moved.select(*key, F.col("a").alias("b"), F.col("to2").alias("nb"))
        links = written(links.join(left, [*key, "a"]).join(right, [*key, "b"]).filter(
            "na <> nb").select(*key, F.col("na").alias("a"), F.col("nb").alias("b")).distinct())
    return labels


def threads(ranked: DataFrame, records: DataFrame, *, min_df=V.TOKEN_MIN_DF,
            max_df: int | None = None, max_members: int | None = V.THREAD_MAX_MEMBERS):
    """``(threads, members)``.

    Words of any frequency relate activities; with ``max_df`` only words in so many at most. A component above
    ``max_members`` is read as several consecutive threads of even size (by urgency, then time); no activity is
    left out.
    """
    tokens = written(group_tokens(ranked))              # read three times
    edges = written(chained(rare_tokens(tokens, min_df=min_df, max_df=max_df), ranked, records))
    roots = connected(edges)
    members = roots.withColumnRenamed("node", "group_id").join(
        ranked.drop("investigation_id"), "group_id")
    order = [F.col("classification.priority_rank"), F.col("first_seen").asc_nulls_last(),
             F.col("activity_rank")]
    placed = number_rows(members, ["investigation_id", "root"], order, "position")
    sizes = roots.groupBy("investigation_id", "root").agg(F.count("*").alias("size"))
    placed = placed.join(sizes, ["investigation_id", "root"])
    if max_members:
        pieces = F.ceil(F.col("size") / max_members)
        piece = F.floor((F.col("position") - 1) * pieces / F.col("size"))
        before = F.ceil(F.col("piece") * F.col("size") / pieces)
    else:
        piece, before = F.lit(0), F.lit(0)
    placed = placed.withColumn("piece", piece.cast("bigint")).withColumn(
        "place", F.col("position") - before)
    why = edges.join(roots.select("investigation_id", F.col("node").alias("a"), "root"),
                     ["investigation_id", "a"]).groupBy("investigation_id", "root").agg(
                         F.min("reason").alias("reason"), F.count("*").alias("links"))
    return describe_threads(placed, tokens, why), placed


def describe_threads(members: DataFrame, tokens: DataFrame, why: DataFrame) -> DataFrame:
    """Shape, urgency, execution statement and counts of each thread, numbered by urgency."""
    key = ["investigation_id", "root", "piece"]
    command = F.coalesce(F.col("full_command_line"), F.lit(""))
    installs = X.installs_something("full_command_line")
    piped, writable = (has_signal("remote_content_to_interpreter"),
                       has_signal("execution_from_writable_location"))
    service = ((F.col("evidence_kind") == V.EXECUTION_EVIDENCE)
               & (F.col("classification.category") == V.NOT_HARMFUL))
    body = members.groupBy(*key).agg(
        F.count("*").alias("activity_count"), F.sum("occurrences").alias("record_count"),
        F.bool_and(piped).alias("_all_piped"), F.bool_or(installs).alias("_installs"),
        F.bool_or(~installs & (command != "")).alias("_uses"),
        F.bool_or(writable).alias("_writable"),
        F.bool_and(F.col("evidence_kind") == V.SESSION_EVENT).alias("_session"),
        F.bool_and(service).alias("_service"),
        F.min("classification.priority_rank").alias("priority_rank"),
        F.min("classification.category_rank").alias("category_rank"),
        F.count_if("execution_confirmed").alias("confirmed"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.transform(F.array_sort(F.collect_list(F.when(
            F.col("place") <= V.THREAD_MAX_MEMBERS,
            F.struct("place", label().alias("text"))))), lambda s: s["text"]).alias("commands"))
    shared = members.select(*key, "group_id").join(tokens, ["investigation_id", "group_id"]).groupBy(
        *key, "token").agg(F.count("*").alias("n"))
    common = shared.join(body.select(*key, "activity_count"), key).filter(
        F.col("n") == F.col("activity_count"))
    few = first_rows(common, key, [F.col("token")], 6).groupBy(*key).agg(
        F.array_sort(F.collect_list("token")).alias("shared_terms"))
    shape = (F.when(F.col("_all_piped"), "remote_installer")
             .when(F.col("_installs") & F.col("_uses"), "install_then_use")
             .when(F.col("_writable"), "unusual_execution").when(F.col("_session"), "session")
             .when(F.col("_service"), "system_service").otherwise("related_activity"))
    titles = F.create_map(*[F.lit(x) for kv in V.THREAD_TITLES.items() for x in kv])
    full = body.join(few, key, "left").join(why, ["investigation_id", "root"], "left").withColumn(
        "shape", shape)
    ready = full.select(
        *key, "shape", titles[F.col("shape")].alias("title"), "reason",
        F.coalesce("shared_terms", F.array().cast("array<string>")).alias("shared_terms"),
        "activity_count", "record_count", "commands", "sources", "first_seen", "last_seen",
        "confirmed", F.when(F.col("confirmed") == 0, "not established")
        .when(F.col("confirmed") == F.col("activity_count"), "confirmed for all")
        .otherwise("confirmed for some").alias("execution"),
        (F.col("confirmed") > 0).alias("execution_confirmed"), "priority_rank",
        F.concat(F.lit("PRIORITY_"), (F.col("priority_rank") + 1).cast("string")).alias("priority"),
        F.element_at(F.array(*[F.lit(c) for c in V.CATEGORY_RANK]),
                     F.col("category_rank") + 1).alias("category"))
    return number_rows(ready, ["investigation_id"], [
        F.col("priority_rank"), F.col("record_count").desc(), F.col("root"), F.col("piece")],
        "thread_number")


def select_reported_threads(found: DataFrame, *, limit=6, min_informative=3) -> DataFrame:
    """Adds ``class`` and ``reported``: urgent threads, then informative ones, up to a page."""
    informative = (F.col("shape") == "install_then_use") | (
        F.col("execution_confirmed") & (F.col("activity_count") >= min_informative))
    kind = (F.when(F.col("priority_rank") == 0, "priority_1")
            .when(F.col("priority_rank") == 1, "priority_2")
            .when(informative, "noteworthy").otherwise("routine"))
    classed = found.withColumn("class", kind)
    shown = first_rows(
        classed.filter("class <> 'routine'"), ["investigation_id"],
        [F.when(F.col("class") == "noteworthy", 2).otherwise(F.col("priority_rank")),
         F.col("thread_number")], limit).select("investigation_id", "thread_number").withColumn(
             "reported", F.lit(True))
    return classed.join(shown, ["investigation_id", "thread_number"], "left").withColumn(
        "reported", F.coalesce("reported", F.lit(False)))


def thread_counts(reported: DataFrame) -> DataFrame:
    return reported.groupBy("investigation_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("class") == c).alias(c) for c in (
            "priority_1", "priority_2", "noteworthy", "routine")],
        F.count_if("reported").alias("printed"))
