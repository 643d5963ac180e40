"""Queries that build, check and describe labelled datasets, and of readers and writers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandmill.functions import text as X
from strandmill.operators import dataset as D
from strandmill.operators import lint
from strandmill.plans.book import query, sql_hash
from strandmill.plans.scalars import EDGE, NORM
from strandmill.sources import files
from strandmill.sources.shared import fresh_path, written
from strandmill.sources.tables import table, tasks_for

SPLIT = f"CASE WHEN {sql_hash('doc_id::VARCHAR')} % 100 < 70 THEN 'train' WHEN {sql_hash('doc_id::VARCHAR')} % 100 < 85 THEN 'val' ELSE 'test' END"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", X.assign_split(F.col("doc_id")).alias("split"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_wins_dedup(spark, d):
    return D.first_wins(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query(f"WITH s AS (SELECT source, {SPLIT} AS split FROM documents) SELECT source, split, 0::BIGINT AS n FROM (SELECT DISTINCT source FROM s), (VALUES ('train'), ('val'), ('test'), ('spare')) v(split) WHERE (source, split) NOT IN (SELECT (source, split) FROM s)")
def empty_cells(spark, d):
    docs = _docs(spark, d)
    grid = docs.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, ("train", "val", "test", "spare")))).alias("split"))
    return grid.join(docs.select("source", "split").distinct(), ["source", "split"], "left_anti").withColumn("n", F.lit(0).cast("long"))


@query(f"SELECT source, count(*) FILTER (WHERE {SPLIT} = 'train') AS train, count(*) FILTER (WHERE {SPLIT} = 'val') AS val, count(*) FILTER (WHERE {SPLIT} = 'test') AS test FROM documents GROUP BY source")
def split_coverage(spark, d):
    return _docs(spark, d).groupBy("source").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])


@query(f"SELECT source, list_sort(list_distinct(list({sql_hash('doc_id::VARCHAR')} % 5))) AS buckets FROM documents GROUP BY source")
def bucket_coverage(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set(X.stable_bucket(F.col("doc_id"), 5))).alias("buckets"))


@query(
    f"""WITH c AS (SELECT DISTINCT source, lang FROM documents), s AS (SELECT range AS salt FROM range(40)), b AS (SELECT salt, source, count(DISTINCT {sql_hash("salt || ':' || lang")} % 2) AS n FROM c, s GROUP BY salt, source)
       SELECT salt FROM b GROUP BY salt HAVING min(n) = 2"""
)
def find_fold_salts(spark, d):
    clusters = table(spark, d, "documents").select("source", "lang").distinct()
    salts = clusters.select("source", "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("salt"))
    bucket = F.pmod(X.hash_int(F.concat_ws(":", "salt", "lang")), F.lit(2))
    per = salts.groupBy("salt", "source").agg(F.count_distinct(bucket).alias("n"))
    return per.groupBy("salt").agg(F.min("n").alias("least")).where("least = 2").select("salt")


@query(f"""WITH t AS (SELECT lang, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS n FROM documents) SELECT lang, count(*) AS n, median(n)::DOUBLE AS middle, quantile_disc(n, 0.9)::BIGINT AS p90 FROM t GROUP BY lang""")
def length_stats(spark, d):
    sized = table(spark, d, "documents").select("lang", X.token_count(F.col("text")).alias("n"))
    return sized.groupBy("lang").agg(F.count("*").alias("n"), F.median("n").alias("middle"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)").cast("long").alias("p90"))


@query(f"""WITH l AS (SELECT lang, source, {SPLIT} AS split, coalesce(CASE WHEN toxic = 1 THEN 'null' WHEN quality = 1 THEN 'true' WHEN quality = 0 THEN 'false' END, 'absent') AS label FROM documents LEFT JOIN labels USING (doc_id)) SELECT coalesce(lang, '-') AS lang, coalesce(split, '-') AS split, coalesce(label, '-') AS label, count(*) AS n FROM l GROUP BY GROUPING SETS ((lang, label), (split, label), (label))""")
def gen_stats(spark, d):
    label = F.coalesce(F.when(F.col("toxic") == 1, "null").when(F.col("quality") == 1, "true").when(F.col("quality") == 0, "false"), F.lit("absent"))
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left").withColumn("label", label)
    sets = rows.groupingSets([["lang", "label"], ["split", "label"], ["label"]], "lang", "split", "label").agg(F.count("*").alias("n"))
    return sets.select(*[F.coalesce(c, F.lit("-")).alias(c) for c in ("lang", "split", "label")], "n")


@query("""WITH n AS (SELECT count(*) AS total FROM documents) SELECT 'quality' AS signal, count(*) FILTER (WHERE quality = 1) AS yes, count(*) FILTER (WHERE quality = 0) AS no, (SELECT total FROM n) - count(*) AS absent FROM labels UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic = 1), count(*) FILTER (WHERE toxic = 0), (SELECT total FROM n) - count(*) FROM labels""")
def label_prior(spark, d):
    total = table(spark, d, "documents").agg(F.count("*").alias("total"))
    long = table(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "signal", "v")
    per = long.groupBy("signal").agg(F.count_if(F.col("v") == 1).alias("yes"), F.count_if(F.col("v") == 0).alias("no"), F.count("*").alias("n"))
    return per.join(F.broadcast(total)).select("signal", "yes", "no", (F.col("total") - F.col("n")).alias("absent"))


@query("""WITH c AS (SELECT conv_id, count(*) - 1 AS companions FROM conversations GROUP BY conv_id), m AS (SELECT conv_id % 3 AS mode, companions FROM c), a AS (SELECT mode, avg(companions) AS mean FROM m GROUP BY mode) SELECT round(max(mean) - min(mean), 6) AS spread, round(max(mean), 6) AS largest FROM a""")
def leak_spread(spark, d):
    per = table(spark, d, "conversations").groupBy("conv_id").agg((F.count("*") - 1).alias("companions"))
    means = per.groupBy((F.col("conv_id") % 3).alias("mode")).agg(F.avg("companions").alias("mean"))
    return means.agg(F.round(F.max("mean") - F.min("mean"), 6).alias("spread"), F.round(F.max("mean"), 6).alias("largest"))


@query("""SELECT role, n AS companions, count(*) AS conversations FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY ALL""")
def companion_stats(spark, d):
    per = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("companions"))
    return per.groupBy("role", "companions").agg(F.count("*").alias("conversations"))


@query(f"SELECT substr(sha256({NORM}), 1, 16) AS cluster, list_sort(list_distinct(list(source))) AS libraries FROM documents GROUP BY {NORM} HAVING count(DISTINCT source) > 1")
def cluster_collisions(spark, d):
    keyed = table(spark, d, "documents").select(F.substring(F.sha2(X.normalise_text(F.col("text")), 256), 1, 16).alias("cluster"), "source")
    return keyed.groupBy("cluster").agg(F.array_sort(F.collect_set("source")).alias("libraries")).where(F.size("libraries") > 1)


LEXICONS = {"nation": ["the", "and"], "trade": ["with", "from"], "time": ["was", "als"]}


@query(
    f"SELECT source AS library, signal, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(lower(text), pattern)) AS matched FROM documents, (VALUES ('nation', '{EDGE[0]}(the|and){EDGE[1]}'), ('trade', '{EDGE[0]}(with|from){EDGE[1]}'), ('time', '{EDGE[0]}(was|als){EDGE[1]}')) v(signal, pattern) WHERE signal <> CASE WHEN source LIKE '%1' THEN 'trade' ELSE 'none' END GROUP BY source, signal"
)
def cross_signal_grid(spark, d):
    own = F.when(F.col("source").like("%1"), "trade").otherwise("none")
    return lint.signal_grid(table(spark, d, "documents").select(F.col("source").alias("library"), own.alias("own_signal"), "text"), LEXICONS)


@query(f"SELECT source AS library, round(count(*) FILTER (WHERE regexp_matches(lower(text), '{EDGE[0]}(with|from){EDGE[1]}')) / count(*)::DOUBLE, 6) AS rate FROM documents GROUP BY source")
def lint_rates(spark, d):
    hit = F.size(X.lexicon_hits(F.lower("text"), LEXICONS["trade"])) > 0
    return table(spark, d, "documents").groupBy(F.col("source").alias("library")).agg(F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"))


RARE = {"tide": ["tide", "harbor"], "winter": ["winter"], "zebra": ["zebra"]}


@query(
    f"""WITH g AS (SELECT source, signal FROM documents, (VALUES ('tide', '{EDGE[0]}(tide|harbor){EDGE[1]}'), ('winter', '{EDGE[0]}winter{EDGE[1]}'), ('zebra', '{EDGE[0]}zebra{EDGE[1]}')) v(signal, pattern) GROUP BY source, signal HAVING count(*) FILTER (WHERE regexp_matches(lower(text), pattern)) = 0)
       SELECT source, list_sort(list(signal)) AS silent FROM g GROUP BY source"""
)
def null_on_proposal(spark, d):
    """Per library the foreign signals on which all of its lines are silent."""
    lines = table(spark, d, "documents").select(F.col("source").alias("library"), F.lit(None).cast("string").alias("own_signal"), "text")
    silent = lint.signal_grid(lines, RARE).where("matched = 0")
    return silent.groupBy(F.col("library").alias("source")).agg(F.array_sort(F.collect_list("signal")).alias("silent"))


def _hits(column, terms):
    """SQL of the sorted list of terms found in a lower-cased column."""
    return f"list_filter({sorted(terms)!r}, lambda t: regexp_matches(lower({column}), '{EDGE[0]}' || t || '{EDGE[1]}'))"


@query(f"SELECT line_id, hedges FROM (SELECT doc_id AS line_id, {_hits('text', lint.HEDGES)} AS hedges FROM documents WHERE source NOT LIKE '%1') WHERE len(hedges) > 0")
def hedge_hits(spark, d):
    kind = F.when(F.col("source").like("%1"), "ambiguous").otherwise("positive")
    return lint.hedge_hits(table(spark, d, "documents").select(F.col("doc_id").alias("line_id"), kind.alias("kind"), "text")).select("line_id", "hedges")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN lang WHEN lang = 'en' AND source > 'src5' THEN 'filler' WHEN lang = 'en' THEN 'companion' END AS role FROM documents")
def build_pools(spark, d):
    docs = table(spark, d, "documents")
    fragments = docs.select("doc_id", F.when(F.col("source") == "src1", "s").when(F.col("source") > "src5", F.lit(None)).otherwise("other").alias("signal_key"), F.when(F.col("source") == "src1", "positive").alias("kind"), F.when(F.col("lang") == "en", F.array(F.lit("s"))).otherwise(F.array()).cast("array<string>").alias("null_on"), "lang")
    role = D.pool_role("s")
    return fragments.select("doc_id", F.when(role == "positive", F.col("lang")).otherwise(role).alias("role"))


#: An order's smallest part of each signal asserts it; its other parts are fillers, which assert nothing.
PARTS = """k AS (SELECT DISTINCT l_orderkey AS example_id, l_partkey AS key, CASE l_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS claim FROM lineitem),
        f AS (SELECT example_id, CASE WHEN key = min(key) OVER (PARTITION BY example_id, claim) THEN claim END AS signal_key, key % 3 = 0 AS asserts, key % 7 <> 0 AS silent FROM k)"""


@query(
    f"""WITH {PARTS}, j AS (SELECT f.*, s AS signal FROM f, (VALUES ('a'), ('b')) v(s)),
        g AS (SELECT example_id, signal, bool_and(coalesce(signal_key = signal, false) OR silent) AS declared, max(CASE WHEN signal_key = signal THEN asserts END) AS value FROM j GROUP BY ALL)
       SELECT example_id, max(CASE WHEN signal = 'a' THEN CASE WHEN declared THEN coalesce(value::VARCHAR, 'null') ELSE 'masked' END END) AS a, max(CASE WHEN signal = 'b' THEN CASE WHEN declared THEN coalesce(value::VARCHAR, 'null') ELSE 'masked' END END) AS b FROM g GROUP BY example_id"""
)
def label_vector(spark, d):
    """Orders as examples of all their parts; a part is one fragment where it asserts its signal and another where it is a filler."""
    claim = lambda key: F.when(key % 3 == 0, "a").when(key % 3 == 1, "b")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("example_id"), F.col("l_partkey").alias("key"))
    tasks = tasks_for(lines)
    first = F.min("key").over(Window.partitionBy("example_id", claim(F.col("key"))))
    parts = lines.repartition(tasks, "example_id").distinct().withColumn("own", (claim(F.col("key")).isNotNull() & (F.col("key") == first)).cast("int"))
    parts = parts.select("example_id", (F.col("key") * 2 + F.coalesce("own", F.lit(0))).alias("fragment_id"))
    key = F.col("p_partkey")
    kinds = table(spark, d, "part").withColumn("own", F.explode(F.array(F.lit(0), F.lit(1))))
    fragments = kinds.select((key * 2 + F.col("own")).alias("fragment_id"), F.when(F.col("own") == 1, claim(key)).alias("signal_key"), (key % 3 == 0).alias("asserts"), F.when(key % 7 != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array()).cast("array<string>").alias("null_on"))
    vectors = D.label_vectors(parts, fragments, ["a", "b"], tasks=tasks)
    shown = lambda s: F.when(F.map_contains_key("labels", s), F.coalesce(F.element_at("labels", s).cast("string"), F.lit("null"))).otherwise("masked")
    return vectors.select("example_id", shown("a").alias("a"), shown("b").alias("b"))


@query(
    f"""SELECT doc_id, CASE WHEN u < 0.35 THEN 'true' WHEN u < 0.7 THEN 'false' WHEN v < 0.5 THEN 'null_ambiguous' ELSE 'null_structural' END AS mode, CASE WHEN w < 0.5 THEN 2 ELSE 3 END AS fragments
       FROM (SELECT doc_id, {sql_hash("'s|' || doc_id || '|f'")} / 4294967296.0::DOUBLE AS w, {sql_hash("'s|' || doc_id || '|m'")} / 4294967296.0::DOUBLE AS u, {sql_hash("'s|' || doc_id || '|n'")} / 4294967296.0::DOUBLE AS v FROM documents)"""
)
def sample_label_mode(spark, d):
    draw = lambda what: D.uniform(F.lit("s"), F.col("doc_id").cast("string"), F.lit(what))
    return table(spark, d, "documents").select("doc_id", D.label_mode(draw("m"), draw("n")).alias("mode"), F.when(draw("f") < 0.5, 2).otherwise(3).alias("fragments"))


@query(
    f"""SELECT doc_id, greatest(0, n - 2) AS low, least(n - 1, 3) AS high, greatest(greatest(0, n - 2), CASE WHEN n - 1 <= 0 THEN 0 ELSE len(list_filter(range(1, least(n - 1, 3) + 1), lambda i: {sql_hash("'c|' || doc_id || '|' || i")} / 4294967296.0::DOUBLE < 0.5)) END) AS companions FROM (SELECT doc_id, doc_id % 5 + 1 AS n FROM documents)"""
)
def sample_companion_count(spark, d):
    n = F.col("doc_id") % 5 + 1
    low, high = D.companion_bounds(n, 3, 2)
    return table(spark, d, "documents").select("doc_id", low.alias("low"), high.alias("high"), D.companion_count(low, high.cast("int"), 0.5, F.lit("c"), F.col("doc_id").cast("string")).cast("long").alias("companions"))


@query(
    f"""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY {sql_hash("conv_id || '|' || turn")}, turn) AS k FROM conversations) SELECT conv_id, turn FROM r WHERE k = 1"""
)
def draw_filler(spark, d):
    drawn = F.min(F.struct(X.hash_int(F.concat_ws("|", "conv_id", "turn")).alias("h"), "turn"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(drawn.alias("m")).select("conv_id", F.col("m.turn").alias("turn"))


def _pools(spark, d):
    rows = table(spark, d, "part")
    role = F.element_at(F.array(*map(F.lit, ("positive", "negative", "ambiguous", "filler"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return rows.select(F.col("p_partkey").cast("string").alias("fragment_id"), role.alias("role"), F.concat_ws(" ", "p_name", "p_partkey").alias("text"))


@query()
def generate(spark, d):
    return D.generate(_pools(spark, d), 500, "g1")


@query()
def noise(spark, d):
    return D.add_noise(table(spark, d, "benchmark"), "item_id", "text", 0.1, "n1", frozenset({"the", "and"}), 0.2)


@query()
def noise_tally(spark, d):
    noisy = written(D.add_noise(table(spark, d, "benchmark"), "item_id", "text", 0.1, "n1"), "noisy")
    words = F.greatest(X.whitespace_count(F.col("text")), F.lit(1))
    return noisy.agg(F.count("*").alias("texts"), F.count_if(F.size("edits") == 0).alias("clean"), F.round(100 * F.sum(F.size("edits")) / F.sum(words), 4).alias("edits_per_100_words"))


@query()
def noise_tree(spark, d):
    """The sidecars of a tree of five folds of documents, all damaged at once."""
    fold = F.pmod(X.hash_int(F.concat(F.lit("n|"), "doc_id")), 5).cast("int")
    examples = table(spark, d, "documents").select(fold.alias("fold"), X.assign_split(F.col("doc_id"), "n").alias("split"), F.col("doc_id").alias("example_id"), "text")
    files = spark.range(5).select(F.col("id").cast("int").alias("fold"), F.explode(F.array(*map(F.lit, ("train", "val", "test")))).alias("split"))
    sidecars = files.select("*", F.lit("quality").alias("signal"), F.lit(False).alias("noised"), F.lit("n").alias("seed"))
    return D.noise_tree(examples, sidecars, 0.05, "n1", {"quality": frozenset({"the", "and"})}, 0.2, ("seed",))[1]


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents")
def round_robin(spark, d):
    return D.round_robin(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"]).orderBy("position", "source")


@query(
    f"""WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents), b AS (SELECT lang, source AS permuted, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash("'z|' || doc_id")}, doc_id) AS p FROM documents)
       SELECT lang, doc_id, source, permuted FROM a JOIN b USING (lang, p)"""
)
def permute_labels(spark, d):
    return D.permute_labels(table(spark, d, "documents").select("lang", "doc_id", "source"), "lang", "source", "doc_id", "z")


@query("SELECT doc_id, [coalesce(quality, -1), coalesce(toxic, -1)] AS target, lang || ':' || doc_id AS qualified FROM documents LEFT JOIN labels USING (doc_id)")
def target_matrix(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.array(*[F.coalesce(c, F.lit(-1)) for c in ("quality", "toxic")]).alias("target"), F.concat_ws(":", "lang", "doc_id").alias("qualified"))


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def labelled_rows(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query(
    """WITH u AS (SELECT 'q' AS tree, doc_id, quality AS v FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT 't', doc_id, toxic FROM labels WHERE doc_id % 3 = 0)
       SELECT doc_id, CASE WHEN count(*) = 2 THEN 'shared:' || doc_id ELSE min(tree) || ':' || doc_id END AS example_id, CASE WHEN count(*) = 2 THEN NULL ELSE max(v) END AS owned FROM u GROUP BY doc_id"""
)
def merge_split(spark, d):
    labels = table(spark, d, "labels")
    tree = lambda n, name, c: labels.where(F.col("doc_id") % n == 0).select(F.lit(name).alias("tree"), "doc_id", F.col(c).alias("v"))
    per = tree(2, "q", "quality").unionByName(tree(3, "t", "toxic")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("tree").alias("tree"), F.max("v").alias("v"))
    return per.select("doc_id", F.concat_ws(":", F.when(F.col("n") == 2, "shared").otherwise(F.col("tree")), "doc_id").alias("example_id"), F.when(F.col("n") != 2, F.col("v")).alias("owned"))


@query("SELECT signal, n, all_keys FROM (SELECT 'quality' AS signal, count(*) AS n, ['quality', 'toxic'] AS all_keys FROM labels UNION ALL SELECT 'toxic', count(*), ['quality', 'toxic'] FROM labels)")
def signals_union(spark, d):
    maps = table(spark, d, "labels").select(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic").alias("m")).select(F.explode("m").alias("signal", "v"))
    per = maps.groupBy("signal").agg(F.count("*").alias("n"))
    keys = maps.agg(F.array_sort(F.collect_set("signal")).alias("all_keys"))
    return per.join(F.broadcast(keys))


@query(f"SELECT p.doc_id, p.source FROM documents p WHERE {SPLIT.replace('doc_id', 'p.doc_id')} = 'test' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id)")
def join_provenance(spark, d):
    return _docs(spark, d).where("split = 'test'").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT l_orderkey, max(CASE WHEN p_partkey % 3 = 0 THEN p_partkey END) AS decisive, count(*) FILTER (WHERE p_partkey % 3 = 0) > 1 AS conflict FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def join_decisive(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    decisive = F.col("p_partkey") % 3 == 0
    return rows.groupBy("l_orderkey").agg(F.max(F.when(decisive, F.col("p_partkey"))).alias("decisive"), (F.count_if(decisive) > 1).alias("conflict"))


@query()
def near_dup_pairs(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("line_id"), F.col("source").alias("library"), X.assign_split(F.col("doc_id")).alias("split"), "text")
    return lint.near_duplicates(lines)


@query("SELECT event_id, user_id, event_type FROM events")
def jsonl_round_trip(spark, d):
    path = fresh_path(spark, "jsonl")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    files.write_json_lines(rows, path)
    return files.json_lines(spark, path, "event_id long, user_id long, event_type string")


@query(f"SELECT DISTINCT 'lib:' || substr(sha1(t), 1, 8) AS fragment_id, CASE WHEN item_id % 2 = 0 THEN 'lib:even' ELSE sha256(t) END AS cluster FROM (SELECT item_id, {NORM.replace('text', 's')} AS t FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM benchmark))")
def text_library_round_trip(spark, d):
    path = fresh_path(spark, "library")
    line = F.regexp_replace("text", r"\s+", " ")
    table(spark, d, "benchmark").select(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("[even] "), line)).otherwise(line).alias("value")).write.text(path)
    lines = files.text_library(spark, path, "lib")
    return lines.select("fragment_id", F.when(F.col("tag").isNotNull(), F.col("cluster_id")).otherwise(F.sha2("cluster_id", 256)).alias("cluster")).distinct()


@query("SELECT doc_id::VARCHAR AS submission_id, signal, state FROM (SELECT doc_id, 'quality' AS signal, CASE quality WHEN 1 THEN 'true' ELSE 'false' END AS state FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN doc_id % 4 = 0 THEN 'omitted' WHEN doc_id % 4 = 1 THEN 'null' WHEN toxic = 1 THEN 'true' ELSE 'false' END FROM labels)")
def holdout_round_trip(spark, d):
    path = fresh_path(spark, "holdout")
    say = lambda c: F.when(F.col(c) == 1, "true").otherwise("false")
    rest = F.col("doc_id") % 4
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("submission_id"), say("quality").alias("quality"), F.when(rest == 0, "").when(rest == 1, "null").otherwise(say("toxic")).alias("toxic"), F.lit("x").alias("text"))
    rows.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return files.holdout_tsv(spark, path, ["quality", "toxic"])


@query("SELECT n_nationkey, n_name FROM nation")
def scan_json_tree(spark, d):
    """One JSON file a nation in a tree, and one below ``synthetic`` that is left out."""
    path = fresh_path(spark, "json-tree")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    rows.withColumn("part", F.col("n_nationkey")).write.partitionBy("part").json(f"{path}/rules")
    rows.where("n_nationkey = 3").write.json(f"{path}/synthetic")
    return files.json_tree(spark, path, "n_nationkey", "n_nationkey long, n_name string").select("n_nationkey", "n_name")


@query("SELECT '## Regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '| - | - |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region")
def sink_report(spark, d):
    text = files.report_rows(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions")
    return spark.createDataFrame([(text,)], "report string")


@query("SELECT doc_id, list_count([CASE WHEN quality IS NOT NULL THEN 1 END, CASE WHEN toxic = 1 THEN 1 END]) AS heads FROM labels")
def labelled_positions(spark, d):
    """Heads that supervise a row: keys of its label map, null values included."""
    labels = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("quality").alias("k"), F.col("quality").alias("v")), F.when(F.col("toxic") == 1, F.struct(F.lit("toxic").alias("k"), F.col("toxic").alias("v"))))))
    held = labels.alias("labels")
    count = sum((F.map_contains_key("labels", s).cast("long") for s in ("quality", "toxic")), F.lit(0).cast("long"))
    return table(spark, d, "labels").select("doc_id", held).select("doc_id", count.alias("heads"))


@query("SELECT DISTINCT lang, split, 7 + 100 * fold + CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS run_seed, 7 + 1000 * fold AS fold_seed FROM (SELECT lang, doc_id % 5 AS fold, " + SPLIT + " AS split FROM documents)")
def run_and_fold_seeds(spark, d):
    fold = F.col("doc_id") % 5
    offset = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return _docs(spark, d).select("lang", "split", (F.lit(7) + 100 * fold + offset).alias("run_seed"), (F.lit(7) + 1000 * fold).alias("fold_seed")).distinct()


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'null' WHEN quality = 1 THEN 'true' ELSE 'false' END AS label_name, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS class_code FROM labels")
def label_name_and_code(spark, d):
    state = F.when(F.col("toxic") == 0, F.col("quality") == 1)
    return table(spark, d, "labels").select("doc_id", F.coalesce(state.cast("string"), F.lit("null")).alias("label_name"), F.when(state, 1).when(~state, 0).otherwise(2).alias("class_code"))


@query("SELECT user_id, list_position(v, list_max(v)) AS best_epoch, len(v) AS epochs FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)")
def epoch_divergence(spark, d):
    from strandmill.operators.ml import best_epochs

    return best_epochs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
