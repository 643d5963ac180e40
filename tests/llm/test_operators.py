import hashlib
import importlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import exact_dedup, packing, sharding, warc

ROWS = [(1, "b"), (2, "a"), (3, None), (4, ""), (5, "a"), (None, "a"), (6, "é" * 3000), (6, "é" * 3000), (7, "A")] + [(i, "copy") for i in range(100, 160)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def tokenizer_path():
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def test_token_ids_equal_those_of_tokenizers():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(tokenizer_path()), packing.TextTokenizer(tokenizer_path())
    texts = ["", " ", "a  b\n\n c\t", "Don't we'll 12345 x²½", "naïve — «déjà» Straße Привет 你好 😀👩‍👩‍👧", "x" * 3000, "a<|endoftext|>b", "  z\u0000", "_" * 99 + " 'S 's", "\r\n \r\n end  "]
    for text in texts:
        assert np.frombuffer(fast.text_ids(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, text


def test_packing_covers_every_id_once(docs):
    pieces = packing.pack_documents(docs.where("doc_id is not null and doc_id <> 6"), tokenizer_path(), 16, with_ids=True).collect()
    fast = packing.TextTokenizer(tokenizer_path())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    texts = {i: t or "" for i, t in ROWS if i not in (None, 6)}
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = [x for p in sorted(own, key=lambda p: p.start) for x in p.ids]
        assert ids == np.frombuffer(fast.text_ids(texts[i]), "<u4").tolist() + [0]
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 16


def packed(df, capacity, **options):
    return packing.pack_documents(df, tokenizer_path(), capacity, with_ids=True, **options).collect()


def test_packing_pads_little(spark):
    texts = [("word " * (n * 7 % 90 + 1)).strip() for n in range(300)]
    rows = packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), 64)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    # What is left over lies in powers of two, one of each, which need no padding.
    short = [n for n in fill.values() if n != 64]
    assert len(short) == len(set(short)) and all(n & (n - 1) == 0 for n in short)


def test_cheapest_sequence_with_room_is_taken():
    """Every step replayed: the longest piece left goes to the cheapest sequence that has room for it, or is cut at the cheapest one with any."""
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 1024, 300), rng.integers(1, 300, 500), np.array([5, 4, 3, 2, 2]), np.array([1])):
        total = int(lengths.sum())
        room = [1024] * (total // 1024) + [1 << b for b in reversed(range(11)) if total % 1024 >> b & 1]
        left, cost, rest, at = list(room), [0.0] * len(room), dict(enumerate(map(int, lengths))), None
        for piece, start, n, sequence, offset in packing.assign(lengths, np.array(room)):
            if at is None or not rest[at]:
                at = piece
                assert rest[piece] == max(rest.values())
            assert piece == at and start == lengths[piece] - rest[piece] and offset == room[sequence] - left[sequence]
            open_ = [j for j in range(len(room)) if left[j] >= rest[piece]] or [j for j in range(len(room)) if left[j]]
            assert sequence == min(open_, key=lambda j: (cost[j], j)) and n == min(rest[piece], left[sequence])
            left[sequence] -= n
            rest[piece] -= n
            cost[sequence] += packing.LINEAR * n + packing.QUADRATIC * n * n
        assert not any(left) and not any(rest.values())


def test_short_pieces_balance_better_than_in_given_order():
    lengths = np.random.default_rng(5).integers(1, 300, 900)
    total = int(lengths.sum()) // 1024
    mine, given, room, at = Counter(), Counter(), 1024, 0
    for _, _, n, sequence, _ in packing.assign(lengths, np.array([1024] * total + [1 << b for b in reversed(range(11)) if lengths.sum() % 1024 >> b & 1])):
        mine[sequence] += n + n * n / 1024
    for n in map(int, lengths):
        while n:
            part = min(n, room)
            given[at] += part + part * part / 1024
            n, room = n - part, room - part
            if not room:
                room, at = 1024, at + 1
    assert np.std([mine[s] for s in range(total)]) < 0.1 * np.std([given[s] for s in range(total)])


def test_packing_takes_odd_rows_and_long_texts(spark):
    rows = [(None, "a b"), (None, None), (6, "c d e"), (6, "c d e"), (7, "long text " * 4000), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("x"), "ids": F.lit(1), "id": F.lit(2)})
    got = packed(df.coalesce(1), 32, block_tokens=512)
    fast, tokens = packing.TextTokenizer(tokenizer_path()), Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    want = Counter()
    for i, t in rows:
        want[i] += len(fast.text_ids(t or "")) // 4 + 1
    assert tokens == want
    assert [x for r in sorted((r for r in got if r.doc_id == 7), key=lambda r: r.start) for x in r.ids] == np.frombuffer(fast.text_ids(rows[4][1]), "<u4").tolist() + [0]
    assert packed(df.limit(0), 32) == []


def test_exact_groups_match_brute_force(docs):
    got = exact_dedup.exact_groups(docs).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
    for r in got:
        (own,) = [g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.doc_id in own and r.group_size == len(own) and r.keep_id == max(i for i in own if i is not None)


def test_no_rows_and_clashing_names(spark, docs):
    odd = docs.withColumns({"digest": F.lit(1), "top": F.lit(2), "won": F.lit(3), "rid": F.lit(4), "group_size": F.lit(5), "size": F.lit(6), "number": F.lit(7), "row": F.lit(8), "hot": F.lit(9)})
    assert exact_dedup.exact_groups(odd).count() == len(ROWS) == sharding.shard_documents(odd, 7).count()
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t in ROWS})
    none = odd.limit(0)
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_exact_copies(none).count() == sharding.shard_documents(none, 7).count() == 0


def test_shards_are_even_and_slots_gapless(docs):
    got = sharding.shard_documents(docs, 7).collect()
    counts = Counter(r.shard for r in got)
    assert sum(counts.values()) == len(ROWS) and max(counts.values()) - min(counts[s] for s in range(7)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    sizes = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == sizes


def test_shuffled_numbers_invert(spark):
    for n in (1, 2, 10, 97, 1000, 9901):
        rows = spark.range(n).withColumn("p", sharding.shuffled_number(F.col("id"), n))
        rows = rows.withColumn("back", sharding.number_at(rows["p"], n)).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_a_walk_takes_as_many_steps_as_values_lie_outside(spark):
    n = 9901
    assert math.prod(sharding._halves(n)) - n == 99
    rows = spark.range(n, n + 99).withColumn("p", sharding._walk(F.col("id"), n, lambda p: p - F.lit(1)))
    assert {r.p for r in rows.collect()} == {n - 1}


def archive_rows():
    """Repeated and null ids, equal URLs over many blocks, long and short copies."""
    long, rows = "<p>" + "ä" * 100, []
    rows += [(3, "http://a.b/x", long), (1, None, long), (2, "http://A.b/", None), (4, "http://c/", "short"), (5, "http://c/", "short")]
    rows += [(6, "http://c/r", "r" * 150), (6, "http://c/s", "r" * 150), (6, "http://c/s", "r" * 150), (7, "http://c/t", "r" * 150)]
    rows += [(None, "http://n/", "n" * 120), (None, "http://n/", "n" * 120), (None, "http://m/", "m" * 120), (9, "http://m/", "m" * 120)]
    rows += [(100 + i, "http://one.example/same", f"<b>{i % 40}</b>" + "z" * (i % 7 * 40)) for i in range(400)]
    rows += [(600 + i, f"http://h{i % 30}.example/{i}?q#f", "big" * 50_000 if i == 5 else f"p{i}") for i in range(200)]
    return rows


def brute_records(rows):
    first, out = {}, Counter()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        known = data in first and len(data) >= 100
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if known else "response", first.get(data) if known else None] += 1
        first.setdefault(data, i)
    return out


def test_archives_read_back(spark):
    rows = archive_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "digest": F.lit("x"), "first": F.lit(2)})
    got = warc.archive_and_read(pages.repartition(5), files=4)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == brute_records(rows)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_common_payloads_take_their_own_way(spark, monkeypatch):
    monkeypatch.setattr(warc, "MANY", 3)
    rows = archive_rows()
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string"), files=3)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == brute_records(rows)


def test_lookups_equal_a_full_scan(spark, tmp_path):
    rows = archive_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    captures = warc.write_archives(pages, f"file://{tmp_path}/archives")
    index = warc.build_index(captures, f"file://{tmp_path}/index", files=4, block_entries=16)
    every = [tuple(r) for r in captures.collect()]
    assert index.count() > 1
    keys = sorted({e[0] for e in every})
    for wanted in (keys, keys[::7], ["example,one)/same"], ["", "zzz", "example,one)/sam", "example,one)/samf"], []):
        got = warc.find_captures(index, f"file://{tmp_path}/index", spark.createDataFrame([(k,) for k in wanted] * 2, "key string"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted((e for e in every if e[0] in wanted), key=str)
    found = warc.find_captures(index, f"file://{tmp_path}/index", spark.createDataFrame([("example,h5)/5?q",)], "key string"))
    (record,) = warc.read_records(found, f"file://{tmp_path}/archives", with_payload=True).collect()
    assert bytes(record.payload) == b"big" * 50_000 and record.url == "http://h5.example/5?q#f"


def test_binary_search_of_files_and_blocks():
    firsts, lasts = ["a", "c", "c", "f"], ["c", "c", "e", "g"]
    for key in ["", "a", "b", "c", "d", "e", "ee", "f", "g", "h"]:
        assert list(warc.files_for(firsts, lasts, key)) == [i for i in range(4) if firsts[i] <= key <= lasts[i]]
    directory = [["a", 0, 1], ["b", 1, 1], ["b", 2, 1], ["d", 3, 1]]
    assert [b[1] for b in warc.blocks_for(directory, "b")] == [0, 1, 2]
    assert [b[1] for b in warc.blocks_for(directory, "c")] == [2] and [b[1] for b in warc.blocks_for(directory, "z")] == [3]


@pytest.mark.parametrize("equal", [0, 300, 900])
def test_equal_rows_in_bulk_are_numbered_in_parts(spark, equal):
    rows = spark.createDataFrame([(i, "own") for i in range(200)] + [(None, "same")] * equal + [(7, "same")] * (equal // 3), "id long, text string").repartition(3)
    stored = sharding.written(rows, "test-rows")
    found, total = sharding.with_row_numbers(stored, ["id", "text"], "number", rows_per_bucket=50)
    assert total == 200 + equal + equal // 3 and set(found.columns) == {"id", "text", "number"}
    got = found.collect()
    assert sorted(r.number for r in got) == list(range(total))
    alone = {r.id: r.number for r in got if r.text == "own"}
    again = {r.id: r.number for r in sharding.with_row_numbers(sharding.written(rows.repartition(5), "test-rows"), ["id", "text"], "number", rows_per_bucket=50)[0].collect() if r.text == "own"}
    assert alone == again
