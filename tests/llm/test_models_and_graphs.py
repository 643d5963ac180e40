import itertools
import math
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import embeddings, language, mixing, quality, url_filter
from strandmill.llm.queries import URL_RULES

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "eng", "ber", "ung"], "cc": ["ло", "ва", "не", "тры"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def remainder(doc_id, modulus):
    return crc32(str(doc_id).encode()) % modulus


# --- mixing -------------------------------------------------------------------------------------


def mixing_rows():
    rng = random.Random(3)
    rows = [(1, None, "web"), (2, "", None), (3, " \t\n", "code"), (4, "w " * 5000, "web"), (4, "a b", "web"), (None, "c d e", "web")]
    for i in range(10, 400):
        rows.append((i, "w " * rng.randint(0, 40), rng.choice(["web"] * 12 + ["code", "books", None])))
    return rows


def brute_targets(sizes):
    """Weights 5, 2, 1 over the sources in order; the excess above 3 sizes goes round again."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, fixed, left = {}, set(), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in order if t not in fixed) for s in order if s not in fixed}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            fixed.add(s)
            left -= target[s]


def test_mix_meets_targets(spark):
    rows = mixing_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out, targets, _ = mixing.mix_sources(docs)
    got = [(r.doc_id, r.members[0], r.size, r.taken) for r in out.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((i, s, n) for i, s, n, _ in got) == Counter((i, s, size(t)) for i, t, s in rows)
    totals, taken = Counter(), Counter()
    for _, s, n, t in got:
        totals[s] += n
        taken[s] += t
        assert 0 <= t <= 3 * n
    targets = {r.source: r.target for r in targets.collect()}
    assert targets == pytest.approx(brute_targets(totals))
    for s in totals:
        assert abs(taken[s] - targets[s]) <= 1
    again, _, _ = mixing.mix_sources(docs.repartition(7))
    assert Counter((r.doc_id, r.members[0], r.size, r.taken) for r in again.where("doc_id <> 4").collect()) == Counter(g for g in got if g[0] not in (4, None))


def test_mix_of_overlapping_sources_and_of_nothing(spark):
    rows = [(i, "w " * 10, m) for i, m in enumerate([["a"]] * 20 + [["a", "b"]] * 20 + [["b", "c"]] * 10 + [[]] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups array<string>")
    out, targets, flows = mixing.mix_sources(docs, membership=docs["groups"])
    delivered = Counter()
    for flow in flows.collect():
        delivered[flow.source] += flow.words
    for t in targets.collect():
        assert delivered[t.source] <= round(t.target)
    assert out.agg({"taken": "sum"}).first()[0] == sum(delivered.values())
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty)[0].count() == 0 and mixing.mixed_documents(empty).count() == 0


def cost(words, given):
    """Convex cost of ``given`` words of a pattern: the k-th repetition costs k squared a word."""
    return sum(max(0, min(words, given - k * words)) * k * k for k in range(3))


def test_flow_is_largest_and_cheapest():
    """Against all whole flows of small networks: as many words as can be, at the least cost."""
    rng = random.Random(2)
    for _ in range(12):
        words = [rng.randint(1, 2) for _ in range(3)]
        members = [("a",), ("a", "b"), ("b", "c")]
        quotas = {s: rng.randint(0, 5) for s in "abc"}
        arcs = [(i, s) for i, m in enumerate(members) for s in m]
        best = None
        for flow in itertools.product(*(range(min(3 * words[i], quotas[s]) + 1) for i, s in arcs)):
            by_pattern, by_source = Counter(), Counter()
            for (i, s), n in zip(arcs, flow):
                by_pattern[i] += n
                by_source[s] += n
            if all(by_pattern[i] <= 3 * words[i] for i in range(3)) and all(by_source[s] <= quotas[s] for s in quotas):
                best = max(best or (0, -(10**9)), (sum(flow), -sum(cost(words[i], by_pattern[i]) for i in range(3))))
        got = mixing.min_cost_flow(words, members, quotas, [0, 1, 4])
        assert (sum(sum(f.values()) for f in got), -sum(cost(w, sum(f.values())) for w, f in zip(words, got))) == best


def test_route_joins_connected_patterns(spark):
    patterns = spark.createDataFrame([(["a", None], 5), (["a"], 4), (["c"], 7), ([], 9), ([None], 2)], "members array<string>, words long")
    quotas = spark.createDataFrame([("a", 6), (None, 4), ("c", 30), ("unused", 3)], "source string, quota long")
    got = {}
    for r in mixing.route(patterns, quotas, [0, 1, 4]).collect():
        got.setdefault(r.source, []).append((tuple(r.members), r.words))
    assert {s: sum(n for _, n in own) for s, own in got.items()} == {"a": 6, None: 4, "c": 21}


def test_many_sources_and_rows_without_ids(spark):
    rows = [(i, "w " * (i % 7), f"s{i:05}") for i in range(3000)] + [(None, f"t{i} " * 8, "null ids") for i in range(200)] + [(7, "same text again", "equal rows")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out, targets, _ = mixing.mix_sources(docs)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    goals = {r.source: r.target for r in targets.collect()}
    assert goals == pytest.approx(brute_targets(sizes))
    taken, kept = Counter(), Counter()
    for r in out.collect():
        taken[r.members[0]] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in goals.items())
    for r in mixing.mixed_documents(docs).collect():
        kept[r.source] += len(r.text.split())
    assert goals["null ids"] - 1 <= kept["null ids"] <= goals["null ids"] + 9
    assert goals["equal rows"] - 1 <= kept["equal rows"] <= goals["equal rows"] + 4


def test_mixed_documents_keep_columns(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "web" if i % 9 else "code", i) for i in range(200)], "doc_id long, text string, source string, members int")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert max(Counter(r.doc_id for r in got.collect()).values()) <= 3


# --- language -----------------------------------------------------------------------------------


def language_rows():
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, rng.randint(8, 120)), lang, "s") for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    return rows + [(900, None, "aa", "s"), (901, "12 345 !?", "aa", "s"), (902, "", None, "s"), (903, "7 " * 4000 + prose(rng, "bb", 3000), None, "s"), (None, prose(rng, "cc", 50), "cc", "s")]


def test_language_of_held_out_texts(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.language_of_documents(docs).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang, _ in rows if i is not None and i < 900 and remainder(i, 4) == 2]
    assert all(got[i].held_out for i, _ in held) and len(held) > 40
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == "und" for i in (900, 901, 902)) and got[903].lang_pred == "bb"


def test_held_out_languages_are_not_learnt(spark):
    rows = language_rows()
    lied = [(i, t, "zz" if i is not None and remainder(i, 4) == 2 else lang, "other") for i, t, lang, _ in rows]
    seen = [{(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.language_of_documents(spark.createDataFrame(x, "doc_id long, text string, lang string, source string")).collect()} for x in (rows, lied)]
    assert seen[0] == seen[1]


def plain_grams(text):
    """Hashed trigrams as the model counts them, one by one."""
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode()]
    return [((data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 2654435761 % 2**32) >> 17 for i in range(len(data) - 2)]


def plain_mixture(counts, weight, langs, rounds=12):
    """(shares, log-likelihood) by expectation-maximisation over dictionaries."""
    p = {g: [(counts[x].get(g, 0) + 0.5) / (sum(counts[x].values()) + 0.5 * language.GRAMS) for x in langs] for g in weight}
    share = [1 / len(langs)] * len(langs)
    for _ in range(rounds if len(langs) > 1 else 0):
        new = [0.0] * len(langs)
        for g, n in weight.items():
            whole = sum(a * b for a, b in zip(p[g], share))
            for j in range(len(langs)):
                new[j] += n * p[g][j] * share[j] / whole
        new = [x / sum(new) for x in new]
        near, share = max(abs(a - b) for a, b in zip(new, share)) < 1e-3, new
        if near:
            break
    return share, sum(n * math.log(sum(a * b for a, b in zip(p[g], share))) for g, n in weight.items())


def plain_language(text, counts):
    """(selected languages, largest share first; shares under all languages) in plain Python."""
    weight, langs = Counter(plain_grams(text)), sorted(counts)
    shares, _ = plain_mixture(counts, weight, langs)
    alone = {x: plain_mixture(counts, weight, [x])[1] for x in langs}
    chosen = [max(langs, key=lambda x: alone[x])]
    reached, own, price = alone[chosen[0]], [1.0], 8.0 * math.log(sum(weight.values()) + 1)
    for x in sorted(langs, key=lambda x: -shares[langs.index(x)]):
        if x in chosen or shares[langs.index(x)] < 0.01:
            continue
        mixed, gained = plain_mixture(counts, weight, [*chosen, x])
        if gained - reached <= price:
            break
        chosen, reached, own = [*chosen, x], gained, mixed
    return [x for _, x in sorted(zip(own, chosen), key=lambda y: -y[0])], dict(zip(langs, shares))


def test_shares_and_sets_match_plain_python(spark):
    rng = random.Random(15)
    train = [(i, prose(rng, x, 30), x) for i, x in enumerate(["aa", "bb", "cc"] * 12)]
    counts = {x: Counter() for x in ("aa", "bb", "cc")}
    for _, t, x in train:
        counts[x].update(plain_grams(t))
    texts = [prose(rng, a, rng.randint(1, 60)) + " " + prose(rng, b, rng.randint(1, 60)) for a in counts for b in counts for _ in range(3)] + ["Zzz qqq", "é", "roka " * 400 + prose(rng, "cc", 40) + prose(rng, "bb", 90)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string").repartition(3))
    got = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).collect()
    several = 0
    for r in got:
        langs, shares = plain_language(texts[r.doc_id], counts)
        assert r.langs == langs and r.score == pytest.approx(shares[langs[0]], abs=1e-9) and r.explained == pytest.approx(sum(shares[x] for x in langs), abs=1e-9)
        several += len(langs) > 1
    assert several > 5


def test_texts_without_letters_and_documents_of_three_languages(spark):
    rows = language_rows()
    rng = random.Random(31)
    three = " ".join(prose(rng, x, 90) for x in SYLLABLES)
    docs = spark.createDataFrame([*rows, (910, "² ½ Ⅷ", None, "s"), (911, "① ②", "aa", "s"), (912, "١٢٣ _ 4", None, "s"), (913, three, None, "s"), (913, "42", None, "s")], "doc_id long, text string, lang string, source string")
    docs = docs.withColumnRenamed("source", "score")
    got = {(r.doc_id, r.lang_pred) for r in language.language_of_documents(docs).where("doc_id >= 910").collect()}
    assert {(910, "und"), (911, "und"), (912, "und"), (913, "und")} < got and len(got) == 5
    kept = language.documents_with_language(docs)
    assert kept.columns == docs.columns
    assert [r.text for r in kept.where("doc_id >= 910").collect()] == [three]


def test_more_languages_than_fit_a_table(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(3)] for i in range(260)}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(own) for _ in range(25)), x) for i, (x, own) in enumerate(words.items())], "doc_id long, text string, lang string")
    got = language.predict(docs, language.fit(docs), ["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_mixture_of_two_languages_and_no_training_rows(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, prose(rng, lang, 80), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    both = spark.createDataFrame([(1, prose(rng, "aa", 150) + " " + prose(rng, "cc", 60))], "doc_id long, text string")
    assert set(language.predict(both, model, ["doc_id"]).first().langs) == {"aa", "cc"}
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.language_of_documents(bare).collect()} == {"und"}
    assert language.language_of_documents(docs.limit(0)).count() == 0


# --- quality ------------------------------------------------------------------------------------


def quality_tables(spark, flip=False):
    rng = random.Random(4)
    docs, labels = [(9000, None, 1), (9001, "", 2), (9002, "x" * 200_000, 3)], [(9000, None), (1, 0), (1, None)]
    for i in range(400):
        good = rng.random() < 0.5
        text = prose(rng, "aa", rng.randint(20, 90)) + "." if good else " ".join(rng.choice(["%%", "12", "#", "aa"]) for _ in range(rng.randint(5, 60)))
        docs.append((i, text, i))
        labels.append((i, int(good) if not (flip and remainder(i, 5) == 0) else 1 - int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string, _label int"), spark.createDataFrame(labels, "doc_id long, quality int"), labels[3:]


def test_quality_of_held_out_texts(spark):
    docs, labels, truth = quality_tables(spark)
    rows, ensemble = quality.score_quality(docs, labels)
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == 403 and ensemble.rules
    held = [(i, y) for i, y in truth if remainder(i, 5) == 0]
    assert len(held) > 40 and all(got[i].held_out for i, _ in held)
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[9000].score == got[9001].score


def test_held_out_labels_are_not_learnt(spark):
    a, b = ({(r.doc_id, round(r.score, 9)) for r in quality.score_quality(*quality_tables(spark, flip)[:2])[0].collect()} for flip in (False, True))
    assert a == b


def plain_features(text):
    """The statistics of a text, by plain Python."""
    text = text or ""
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], [x for x in text.split("\n") if x]
    share = lambda a, b: a / max(b, 1)
    of = lambda *kinds: sum(unicodedata.category(c) in kinds for c in text)
    symbols = sum(not (unicodedata.category(c)[0] in "LN" or c in " \t\n\x0b\f\r.,;:'\"()-") for c in text)
    return {
        "words": len(words), "word_length": share(len(text), len(words)), "distinct_word_share": share(len(set(words)), len(words)), "distinct_line_share": share(len(set(lines)), len(lines)),
        "line_length": share(len(text), len(lines)), "upper_share": share(of("Lu"), len(text)), "digit_share": share(of("Nd"), len(text)), "symbol_share": share(symbols, len(text)), "stop_share": share(sum(c in ".!?" for c in text), len(words)),
    }


def test_scores_match_plain_python(spark):
    docs, labels, _ = quality_tables(spark)
    docs = docs.unionByName(docs.where("doc_id < 20")).withColumn("score", F.lit("x"))  # repeated rows and a clashing name
    rows, ensemble = quality.score_quality(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = rows.collect()
    assert len(got) == docs.count() and any(len(r.bounds) > 1 for r in ensemble.rules)
    for r in got:
        x = plain_features(texts[r.doc_id])
        odds = ensemble.intercept + sum(rule.weight for rule in ensemble.rules if all((x[n] > t) == above for n, above, t in rule.bounds))
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)


def test_quality_without_labels(spark):
    docs, labels, _ = quality_tables(spark)
    rows, ensemble = quality.score_quality(docs, labels.limit(0))
    assert not ensemble.rules and {round(r.score, 6) for r in rows.collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels)[0].count() == 0


# --- URL verdicts -------------------------------------------------------------------------------


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute_rule(host, path):
    best = None
    for line in URL_RULES:
        verdict, place = line.split(" ")
        rule_host, _, tail = place.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + tail) and (best is None or len(place) > len(best[0])):
            best = (place, verdict)
    return best or (None, None)


def brute_verdicts(rows):
    """Method verdict of every host: two personalised PageRanks by repeated multiplication."""
    seeds, edges, hosts = {k: Counter() for k in ("allow", "block", None)}, Counter(), {brute_host_path(u)[0] for _, u, _ in rows}
    for _, url, html in rows:
        host, path = brute_host_path(url)
        seeds[brute_rule(host, path)[1]][host] += 1
        for other in {m.lower() for m in re.findall(r"(?i)href=\"?https?://([^/\">]+)", html or "")}:
            if host and other and other != host:
                edges[host, other] += 1
    for child in hosts:
        parent = child.partition(".")[2]
        if child and parent in hosts and parent:
            edges[child, parent] += 1
            edges[parent, child] += 1

    def spread(start, arcs):
        out, rank = Counter(), {h: 0.15 * m for h, m in start.items()}
        for (a, _), w in arcs.items():
            out[a] += w
        for _ in range(12):
            new = defaultdict(float, {h: 0.15 * m for h, m in start.items()})
            for (a, b), w in arcs.items():
                new[b] += 0.85 * rank.get(a, 0.0) * w / out[a]
            rank = new
        return rank

    trust, distrust, neutral = spread(seeds["allow"], edges), spread(seeds["block"], {(b, a): w for (a, b), w in edges.items()}), spread(seeds[None], {})
    blocked = lambda h: round(distrust.get(h, 0) - 0.5 * (distrust.get(h, 0) + trust.get(h, 0) + neutral.get(h, 0)), 9) > 0
    return {h: "block" if blocked(h) else "allow" for h in hosts}


def url_rows():
    rng = random.Random(6)
    hosts = ["com", "Example.COM", "www.example.com", "a.net", "example.net", "x.org", "org", "blogs.example", "hub.example", "notcom"]
    rows = [(None, "http://x.org/fr/", "<a href=https://long.example/>" * 20_000), (1, None, "x"), (2, "no scheme/en/7", None), (3, "http://", ""), (4, "http://example.com?/en/7", None), (5, "http://example.com/en/7#x", None), (6, "s://a.com/en/70?q", None), (6, "s://a.com/en/70?q", None)]
    for i in range(10, 260):
        link = "".join(f'<a href="https://{rng.choice(hosts)}/p">' for _ in range(rng.randint(0, 4)))
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'en/7', 'de/', 'de/8', 'es/', 'fr/'])}{rng.choice(['', '?a', '#b', 'c'])}", link))
    return rows


def test_url_verdicts_match_brute_force(spark):
    rows = url_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    pages = pages.withColumns({"host": F.lit(1), "rule": F.lit(2), "kind": F.lit(3), "src": F.lit(4)})
    got = Counter(map(tuple, url_filter.judge_pages(pages, url_filter.parse_rules(URL_RULES)).collect()))
    by_host, want = brute_verdicts(rows), Counter()
    for i, url, _ in rows:
        host, path = brute_host_path(url)
        rule, verdict = brute_rule(host, path)
        want[i, host, path, rule, verdict or by_host[host]] += 1
    assert got == want and len({v for *_, v in want}) == 2


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_pages(pages, url_filter.parse_rules(URL_RULES)).count() == 0


# --- embeddings ---------------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(60):
        base, label = rng.standard_normal(32), int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 12))):
            near = base + rng.standard_normal(32) * rng.choice([0.02, 0.08, 0.12, 0.16])
            rows.append([[float(np.float32(x)) for x in near], label])
    rows += [rows[0]] * 40 + [[rows[1][0], None], [None, 1], [[], 1], [[0.0] * 32, 1], [[float("nan")] + [1.0] * 31, 1], [[None] + [1.0] * 31, 1], [[float("inf")] * 32, 1], [[1.0, 2.0], 1], [[2.0, 4.0], 1]]
    return [(i, *row) for i, row in enumerate(rows)]


def brute_links(rows):
    sound = [(i, np.array(v, dtype=np.float64), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for k, (i, x, label) in enumerate(sound):
        for j, y, other in sound[k + 1 :]:
            if label == other and len(x) == len(y) and x @ y >= 0.98 * math.sqrt((x @ x) * (y @ y)):
                links[i].add(j)
                links[j].add(i)
    return links


def test_near_vectors_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit(1), "copies": F.lit("x"), "h1": F.lit(2)})
    got = {r.vec_id: r for r in embeddings.near_duplicates(df.repartition(3)).collect()}
    links = brute_links(rows)
    assert set(got) == set(links)
    assert all(got[i].n_links <= len(own) for i, own in links.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(map(len, links.values()))
    for i, own in links.items():
        if not own:
            assert (got[i].component_id, got[i].kept) == (i, True)
        assert got[i].kept == (got[i].component_id == i) and got[i].component_id <= i
    assert got[len(rows) - 1].component_id == len(rows) - 2


def crowd(seed):
    """Pairs at and around the limit, all of one label, and a place that no cut divides."""
    rng = np.random.default_rng(seed)
    rows, r = [], math.sqrt(2 - 2 * 0.98)
    for _ in range(600):
        x, y = rng.standard_normal((2, 48))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        angle = 2 * math.asin(r * rng.choice([0.5, 0.9, 0.99, 1.01, 1.2]) / 2)
        rows += [[x.tolist(), 7], [(math.cos(angle) * x + math.sin(angle) * y).tolist(), 7]]
    centre = rng.standard_normal(48)
    rows += [[(centre + 0.03 * rng.standard_normal(48)).tolist(), 7] for _ in range(150)]
    return [(i, *row) for i, row in enumerate(rows)]


def test_cut_runs_keep_pairs_together_and_count_them_once(spark, monkeypatch):
    rows = crowd(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    links = brute_links(rows)
    assert df.where(embeddings.usable("label", "embedding")).count() == len(rows)
    for run, short in ((10_000, 60), (300, 40), (100, 100)):
        monkeypatch.setattr(embeddings, "RUN", run)
        monkeypatch.setattr(embeddings, "SHORT", short)
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
        assert all(got[i] <= len(own) for i, own in links.items())
        assert sum(got.values()) >= 0.97 * sum(map(len, links.values()))
        assert all(got[i] == len(links[i]) for i in range(1200, 1350))
    cuts = embeddings.upper_cuts(df.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector")), 1350, 41)
    stored = embeddings.placed_vectors(df.select("label", F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("vector")), cuts, embeddings.WINDOW * 0.2, 41).count()
    assert len(cuts) > 1 and stored < 1350 * 1.3 ** (len(cuts).bit_length() - 1)


def test_vectors_with_null_and_repeated_ids(spark):
    x, y = [1.0, 0.0, 0.1], [1.0, 0.0, 0.11]
    rows = [(None, x, 1), (5, x, 1), (5, y, 1), (3, y, 1), (None, [0.0, 1.0, 0.0], 2), (9, [0.0, 1.0, 0.0], 3), (None, None, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(None, 3, 3, False), (5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (None, 0, None, False), (9, 0, 9, True), (None, 0, None, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_vectors_and_only_unusable_ones(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = embeddings.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], schema)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_quality_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i} of many with one id") for i in range(400)] + [(2, "alone"), (2, "alone"), (3, None), (None, "no id")], "doc_id long, text string").withColumn("_hash", F.lit("clash"))
    chosen = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, _label int")
    sample = quality.sample_features(docs, chosen, "doc_id", "text").collect()
    assert sorted(r["_label"] for r in sample) == [0, 1, 1] and sorted(r["words"] for r in sample) == [0.0, 1.0, 7.0]


def test_flow_of_many_overlapping_sources_is_quick_and_within_bounds():
    draw = random.Random(6)
    members = sorted({tuple(sorted(draw.sample(range(100), draw.randint(1, 8)))) for _ in range(4000)})
    supplies = [draw.randint(0, 1000) for _ in members]
    quotas = {s: sum(supplies) * draw.randint(0, 200) // 10_000 for s in range(100)}
    began = time.perf_counter()
    flows = mixing.min_cost_flow(supplies, members, quotas, [0, 1, 4])
    assert time.perf_counter() - began < 20
    taken = Counter()
    for words, own, flow in zip(supplies, members, flows):
        assert set(flow) <= set(own) and sum(flow.values()) <= 3 * words
        taken.update(flow)
    assert all(taken[s] <= q for s, q in quotas.items())
    # Every source has far more on offer than it may take, so all quotas are met.
    assert dict(taken) == {s: q for s, q in quotas.items() if q}
