"""Each corpus operator against a plain version, on rows with nulls, repeats, ties, long texts and clashing columns."""

import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillbank.llm import _text
from quillbank.llm._cluster import components
from quillbank.llm.best_fit_packing import best_fit_packing, plan_packing, vocabulary_path
from quillbank.llm.exact_topk import exact_topk
from quillbank.llm.media_columns import cosine_hash, decode_png, encode_png, image_features, padded, store_texts, unfilter
from quillbank.llm.ngram_jaccard import jaccard_classes
from quillbank.llm.perspective_chat import OP2_SQL, rotate_perspectives
from quillbank.llm.quality_classifier import CHUNK, FILTERS, OVERLAP, STRIDE, WIDTH, fit, score_quality, scores, train
from quillbank.llm.source_mixing import mix_sources, mixed_sizes, sainte_lague, shard_quotas, targets
from quillbank.llm.substring_dedup import substring_dedup
from quillbank.llm.token_counts import LongestMatch, token_counts
from quillbank.llm.wrapper_induction import _numbers, extract_main_text, main_text, parse, skeleton, tree_match

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, keys string, size int, score string, bucket string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "漢字", "É", "x" * 400]
    passage = rng.choices(vocabulary, k=30)
    out = {}
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 13, 40, 120]))
        if i % 5 == 0:
            words += passage
        if i % 7 == 3:
            words = (out[i - 1] or "").split()
            for _ in range(len(words) // 40):
                words[rng.randrange(len(words))] = "new"
        out[i] = rng.choice([" ", "\n", "\t "]).join(words)
    out[60], out[61], out[62] = None, "", " \n "
    out[63] = " ".join(rng.choices(vocabulary, k=60_000))
    out[64], out[65] = out[5], out[5].upper()
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "b", "a", "c"][i % 4], 0, "k", 1, "s", "b") for i, t in texts.items()]
    rows += [rows[7], (None, texts[8], "en", "a", 0, "k", 1, "s", "b")]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def test_word_hashes_do_not_depend_on_place():
    long = b"q" * 300_000
    parts = [b"one two", b"", b"two  one\x0b" + long, b"caf\xc3\xa9\xc2\xa0x"]
    data, bounds = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    starts, ends, first = _text.spans(data, bounds)
    assert [data[s:e].tobytes() for s, e in zip(starts, ends)] == [b"one", b"two", b"two", b"one", long, parts[3]]
    assert first.tolist() == [0, 2, 2, 5, 6]
    h = _text.word_hashes(data, starts, ends)
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 4
    alone = np.frombuffer(long, np.uint8)
    assert _text.word_hashes(alone, np.array([0]), np.array([len(long)]))[0] == h[4]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    rng.shuffle(edges)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges] + [(None, 5)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(0)
    for payload in (b"\xff" * 576, b"abc " * 1440, rng.integers(0, 256, 576 * 300, np.uint8).tobytes()):
        png = encode_png(payload)
        assert decode_png(png).tobytes() == payload
        for at in (0, 20, len(png) // 2, len(png) - 2):
            with pytest.raises(ValueError):
                decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        encode_png(b"abc")


def test_every_png_filter_is_taken_back():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 12), np.uint8).astype(int)
    kinds, lines = np.arange(10, dtype=np.uint8) % 5, np.zeros((10, 12), np.uint8)
    for y in range(10):
        for x in range(12):
            a, b = image[y, x - 1] if x else 0, image[y - 1, x] if y else 0
            c = image[y - 1, x - 1] if x and y else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            lines[y, x] = (image[y, x] - [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
    assert (unfilter(kinds, lines) == image).all()


def test_media_columns(docs, texts, empty):
    got = image_features(store_texts(docs)).collect()
    assert len(got) == docs.count() and image_features(store_texts(empty)).count() == 0
    for r in got:
        data = (texts[8 if r["doc_id"] is None else r["doc_id"]] or "").encode()
        payload = padded(data)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload)) and len(payload) % 576 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    by = {r["doc_id"]: r["hash"] for r in got}
    assert by[5] == by[64] and by[60] == by[61]
    image = np.tile(np.arange(576, dtype=np.uint8), (40, 1))
    assert cosine_hash(image) == cosine_hash(np.clip(image.astype(int) + 1, 0, 255).astype(np.uint8))


def _plain_perspectives(rows, size):
    """rotate_perspectives() in plain Python."""
    out, talks = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is None, turn or 0, "unknown" if role is None else role, text or ""))
    name = lambda r: r.replace("%", "%25").replace("|", "%7C").replace("<", "%3C").replace(">", "%3E").replace("\n", "%0A")
    for conv, turns in talks.items():
        turns.sort()
        for who in {r for _, _, r, _ in turns} - {"system"}:
            for at in range(0, len(turns), size):
                part = turns[at : at + size]
                shown = [f"<|{r if r == 'system' else 'assistant' if r == who else 'user name=' + name(r)}|>\n{t.replace('<|', '<||')}<|end|>\n" for _, _, r, t in part]
                out[conv, who, at // size] = len(part), "".join(shown), "".join(str(int(r == who)) for _, _, r, _ in part), sum(len(t.replace("<|", "<||")) for _, _, r, t in part if r == who)
    return out


def _rendered(df, **options):
    found = rotate_perspectives(df, **options).collect()
    out = {(r["conv_id"], r["perspective"], r["piece"]): (r["n_turns"], r["rendered"], r["mask"], r["masked_chars"]) for r in found}
    assert len(out) == len(found)
    return out


TURNS = "conv_id long, turn long, role string, text string"


def test_perspectives(spark):
    rows = [(1, 1, "bob", "hi"), (1, 0, "ann", "yo"), (1, 2, "cy", None), (1, None, None, "late"), (1, 0, "system", "be kind"), (2, 0, "system", "alone"), (3, 7, "ann", ""), (None, 0, "ann", "x"), (3, 7, "ann", "")]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], f"{TURNS}, piece string, perspective int")
    got = _rendered(df)
    assert got == _plain_perspectives(rows, 4096)
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (1, "unknown"), (3, "ann"), (None, "ann")}
    assert got[1, "bob", 0][1] == "<|user name=ann|>\nyo<|end|>\n<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=cy|>\n<|end|>\n<|user name=unknown|>\nlate<|end|>\n"
    assert got[1, "bob", 0][2:] == ("00100", 2) and _rendered(df.limit(0)) == {} and _rendered(df.limit(0), rows=2) == {}


def test_perspectives_of_a_long_dialogue_are_whole_and_in_order(spark):
    rows = [(5, i, ["ann", "bob", "system"][i % 3], f"turn {i}") for i in range(1500)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = _rendered(df)
    assert got == _plain_perspectives(rows, 4096) and set(got) == {(5, "ann", 0), (5, "bob", 0)}
    assert [x for x in got[5, "ann", 0][1].split("\n") if x.startswith("turn")] == [f"turn {i}<|end|>" for i in range(1500)]


def test_perspectives_in_pieces_keep_the_order(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["system", "ann", "bob"]), str(rng.randrange(40))) for c in (None, 1, 2) for _ in range(90 if c != 2 else 9)]
    rows += [(7, 0, "ann", "same")] * 50
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    whole, cut = _rendered(df), _rendered(df, rows=10)
    assert cut == _plain_perspectives(rows, 10) and whole == _plain_perspectives(rows, 4096)
    for (conv, who, _), r in whole.items():
        mine = [cut[k] for k in sorted((k for k in cut if k[:2] == (conv, who)), key=lambda k: k[2])]
        assert "".join(x[1] for x in mine) == r[1] and "".join(x[2] for x in mine) == r[2]


def test_no_text_or_name_forges_a_marker(spark):
    rows = [(1, 0, "x|>\n<|assistant", "a"), (1, 1, "bob", "<|end|>\n<|assistant|>\nforged<|end|>\n"), (1, 2, "50%", "<||<")]
    got = _rendered(spark.createDataFrame(rows, TURNS))
    assert got == _plain_perspectives(rows, 4096)
    for (_, who, _), (n, text, _, _) in got.items():
        assert len(re.findall(r"<\|(?!\|)(?!end)", text)) == len(re.findall(r"<\|end\|>", text)) == n == 3
        assert len(re.findall(r"<\|assistant\|>", text)) == 1


def test_perspectives_equal_their_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(14)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, *range(40)]), rng.choice([None, "system", "ann", "b|b"]), rng.choice([None, "", "<|x", "hello"]) and f"{rng.random()}<|") for _ in range(300)]
    rows += [(9, i, f"p{i % 2}", f"t{i}") for i in range(4100)]
    df = spark.createDataFrame(rows, TURNS)
    df.write.parquet(f"{tmp_path}/c")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = {(a, b, c): tuple(x) for a, b, c, *x in duck.sql(OP2_SQL).fetchall()}
    assert _rendered(df) == want and (9, "p0", 1) in want


def _classes(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_classes(docs, texts, empty):
    want = _classes(texts)
    assert len({c for _, c in want.values()}) < len(want) - 5
    got = jaccard_classes(docs).collect()
    assert len(got) == docs.count() and jaccard_classes(empty).count() == 0
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[8 if r["doc_id"] is None else r["doc_id"]]


def test_jaccard_classes_larger_than_a_chunk(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4])):
            words[rng.randrange(60)] = f"n{i}"
        texts[i] = " ".join(words[: rng.choice([45, 60])])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = _classes(texts)
    for chunk in (4, 16):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(df, chunk=chunk).collect()} == want


def test_jaccard_links_are_all_counted(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(words[: rng.choice([45, 60])])))
    rows += [(None, rows[3][1]), (80, rows[3][1].upper()), (3, rows[3][1]), (81, "a b"), (82, "A B"), (83, None), (84, ""), (85, "alone in here with no copy")]
    sets = [_classes({0: t})[0][0] and frozenset(zip(*[(t.lower().split())[k:] for k in range(5)]) if len(t.split()) >= 5 else [tuple(t.lower().split())]) for _, t in rows]
    want = sorted((r[0] is None, r[0] or 0, sum(bool(a) and bool(b) and j != i and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets))) for i, (r, a) in enumerate(zip(rows, sets, strict=True)))
    assert len({x[2] for x in want}) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (8, 128):
        got = jaccard_classes(df, chunk=16, block=block).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_links"]) for r in got) == want


def test_links_of_a_chain_are_counted_with_few_rows(spark, monkeypatch):
    """Each text is like its two neighbours on either side; rows dealt double with the documents, and all links count."""
    from quillbank.llm import ngram_jaccard

    dealt, plain = [], ngram_jaccard.counting_groups

    def counting(*args):
        out = plain(*args)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(ngram_jaccard, "counting_groups", counting)
    for n in (300, 600, 1200):
        rows = [(i, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 150))) for i in range(n)]
        got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=32).collect()}
        near = sum(100 * (146 - 10 * d) >= 75 * (146 + 10 * d) for d in range(1, 15))
        assert got == {i: (0, min(i, near) + min(n - 1 - i, near)) for i in range(n)} and near >= 2
    assert dealt[2] < 2.2 * dealt[1] < 4.84 * dealt[0] and dealt[2] < 12 * 1200, dealt


def _paragraph_mix(n, seed=11):
    """Documents of 8 out of 60 paragraphs each: many share paragraphs, hardly any two are similar."""
    rng = random.Random(seed)
    paragraphs = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(60)]
    return [" ".join(paragraphs[k] for k in rng.sample(range(60), 8)) for _ in range(n)]


def test_jaccard_classes_of_paragraph_mixes(spark, monkeypatch):
    from quillbank.llm import ngram_jaccard

    dealt = []
    plain = ngram_jaccard._verified

    def counting(rows, percent, n):
        dealt.append(rows.count())
        return plain(rows, percent, n)

    monkeypatch.setattr(ngram_jaccard, "_verified", counting)
    totals = []
    for n in (500, 1000, 2000):
        rows = list(enumerate(_paragraph_mix(n)))
        dealt.clear()
        got = {r["doc_id"]: r["component_id"] for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk=16, links=False).collect()}
        totals.append(sum(dealt))
        assert len(got) == n
    assert totals[2] < 2.5 * totals[1] < 6.25 * totals[0] and totals[2] < 16 * 2000, totals


def test_jaccard_groups_are_split_by_further_tokens(spark):
    texts = _paragraph_mix(120, 1)
    rng = random.Random(7)
    for i in range(0, 120, 3):  # near copies, and copies in another order of paragraphs
        words = texts[i].split()
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(5)}"
        texts.append(" ".join(words))
        texts.append(" ".join(texts[i].split()[80:] + texts[i].split()[:80]))
    rows = list(enumerate(texts))
    want = _classes(dict(rows))
    assert 40 < len({c for _, c in want.values()}) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group, levels in ((4, 6), (4, 1), (64, 6)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(df, chunk=4, links=False, group_size=group, levels=levels).collect()}
        assert got == want


def test_jaccard_moves_few_bytes_of_sets_without_partner(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.integers(0, 1 << 40, 400).astype(str)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    written = lambda: sum(x.totalShuffleWrite() for x in _java_list(spark, spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    got = jaccard_classes(df, links=False).collect()
    assert len(got) == 500 and all(r["component_id"] == r["doc_id"] for r in got)
    assert written() - before < 5 * 500 * 396  # 7 bytes a shingle if all were moved


def _java_list(spark, seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_jaccard_first_shingles_lose_no_partner_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    rows = []
    for n in (1, 2, 3, 4, 5, 7, 8, 20, 100, 333, 400):
        words = rng.integers(0, 1 << 40, 2 * n).astype(str)
        cut = -(-3 * n // 4)
        same = 2 * n * 75 // 175 + (2 * n * 75 % 175 > 0)  # the least overlap of two sets of n that link
        rows += [words[:n], words[:cut], words[: max(1, cut - 1)] if n > 4 else words[:n], words[n - same : 2 * n - same], words[-1:]]
    texts = {i: " ".join(x) for i, x in enumerate(rows)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    sets = [frozenset(x.tolist()) for x in rows]
    linked = [sum(100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    assert {r["doc_id"]: r["n_links"] for r in jaccard_classes(df, words=1).collect()} == dict(enumerate(linked))


def test_near_copies_are_not_reported_by_every_hash_range(spark, monkeypatch):
    """The rows that hash ranges report do not follow their number where most sets that share anything are near copies."""
    from quillbank.llm import ngram_jaccard

    rng = np.random.default_rng(13)
    texts = []
    for i in range(100):
        words = rng.integers(0, 1 << 40, 400).astype(str)
        texts += [" ".join(words), " ".join([*words[:390], *(f"n{i}x{k}" for k in range(10))]), " ".join([*words[:360], *(f"m{i}x{k}" for k in range(40))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    reported, plain = spark.sparkContext.accumulator(0), ngram_jaccard._count_first

    def counting(*args):
        inner = plain(*args)

        def run(batches):
            for batch in inner(batches):
                reported.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(ngram_jaccard, "_count_first", counting)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        got = {r["doc_id"]: r["component_id"] for r in jaccard_classes(df, links=False).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {i - i % 3 for i in got} == set(got.values()) and all(got[i] == i - i % 3 for i in got)
    assert reported.value < 10 * len(texts), reported.value  # nearly 32 a text if each range reported all that share a shingle


def test_only_shingles_of_sets_of_like_size_count():
    from quillbank.llm import ngram_jaccard as nj

    sizes = np.array([75, 100, 101, 300])
    pack = lambda i: (np.arange(5, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), np.int64(i).tobytes(), np.uint32(5).tobytes(), nj.size_class(sizes[i : i + 1]).tobytes())
    for some, want in (((0, 1), {0, 1}), ((0, 3), set()), ((0, 1, 3), {0, 1}), ((2, 3), set()), ((3, 3), set())):
        owners = nj._held_by_like([pack(i) for i in some], nj.classes_apart(75))
        assert set(owners.tolist()) == want and len(owners) == 5 * len(want)
    n = np.arange(1, 100_000)
    for percent in (1, 50, 75, 90, 100):
        least = -(-percent * n // 100)
        assert (nj.size_class(n).astype(int) - nj.size_class(least) <= nj.classes_apart(percent)).all()


def test_ranges_follow_the_volume_and_not_the_partitions(monkeypatch):
    """A set's id goes to at most RANGES ranges; a large range is counted in pieces, with the same tokens."""
    from quillbank.llm import ngram_jaccard as nj

    assert [nj.ranges(n, 10**6) for n in (1, 12, 600, 20_000)] == [1, 12, nj.RANGES, nj.RANGES] and nj.ranges(12, 1000 * nj.RANGE) == 1000
    rng = random.Random(3)
    texts = [" ".join(f"w{k}" for k in range(10 * i, 10 * i + rng.randint(20, 90))) for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})
    none = np.zeros(0, np.int64)
    packed, first = (list(nj._pack(nj.WORDS, 2, none, percent)(iter([batch]))) for percent in (0, 75))
    packed, first = ([pa.Table.from_batches(x).sort_by("bucket").to_batches()[0]] for x in (packed, first))
    found = []
    for piece in (1 << 20, 500):
        monkeypatch.setattr(nj, "PIECE", piece)
        tokens = Counter()
        for x in nj._count(iter(packed)):
            for r in x.to_pylist():
                tokens[r["set_id"], r["key"], r["check"], r["sets"]] += r["weight"]
        counted = sorted(tuple(r.values()) for x in nj._count_first(np.zeros(1 << 12, np.uint8), 75)(iter(first)) for r in x.to_pylist())
        found.append((tokens, counted))
    assert found[0] == found[1] and len(found[0][0]) > 200 and len(found[0][1]) > 200


def test_rows_of_one_set_are_moved_once(spark):
    """Repeated texts are hashed and moved by one of their rows, whatever their doc_ids and partitions."""
    rng = np.random.default_rng(21)
    words = [rng.integers(0, 1 << 40, 400).astype(str) for _ in range(200)]
    texts = [" ".join([*x[: 400 - 20 * k], *(f"n{i}x{j}" for j in range(20 * k))]) for i, x in enumerate(words) for k in (0, 1)]
    written = lambda: sum(x.totalShuffleWrite() for x in _java_list(spark, spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    moved = []
    for times in (1, 8):
        rows = [(None if i % 50 == 0 and k else i + 400 * k, t) for k in range(times) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(8).localCheckpoint()
        before = written()
        got = {(r["doc_id"], r["component_id"]) for r in jaccard_classes(df, links=False).collect()}
        moved.append(written() - before)
        assert got == {(i, None if i is None else i % 400 // 2 * 2) if i is not None else (None, 0) for i, _ in rows if i is not None} | ({(None, i // 2 * 2) for i in range(0, 400, 50)} if times > 1 else set())
    assert moved[1] < 2 * moved[0], moved


def test_sets_that_the_bitmap_has_by_chance_go_on(spark, monkeypatch):
    """Pairs of texts that are only found by counting are found too where the bitmap holds many others."""
    from quillbank.llm import ngram_jaccard

    monkeypatch.setattr(ngram_jaccard, "FILTER_BITS", 15)
    texts = []
    for i in range(1500):
        words = [f"a{i}x{k}" for k in range(60)]
        texts += [" ".join(words), " ".join([*words[:59], f"b{i}"])]
    for i in range(400):
        words = [f"c{i}x{k}" for k in range(60)]
        texts += [" ".join(words), " ".join([*words[:53], *(f"d{i}x{k}" for k in range(7))])]  # 49 of 63 shingles
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_classes(df, links=False).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))}


def test_large_components_are_counted_in_few_blocks(spark, monkeypatch):
    from quillbank.llm import ngram_jaccard

    dealt, plain = [], ngram_jaccard.counting_groups

    def counting(*args):
        out = plain(*args)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(ngram_jaccard, "counting_groups", counting)
    words = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join([*words, f"n{i}"])) for i in range(400)]
    got = {(r["component_id"], r["n_links"]) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert got == {(0, 399)} and dealt[0] <= ngram_jaccard.BLOCKS * 400, dealt  # 25 blocks of 16 would be 10,000 rows


def test_sets_of_one_id_are_told_apart():
    import pyarrow as pa

    from quillbank.llm.ngram_jaccard import WORDS, _shingles

    batch = pa.RecordBatch.from_pydict({"text": [f"a{i // 2} b c d e f g{i // 2}" for i in range(8)]})
    _, _, ids, check = _shingles(batch, WORDS, np.zeros(0, np.int64))
    assert len(set(ids.tolist())) == len(set(check.tolist())) == 4 and (ids[::2] == ids[1::2]).all() and (check[::2] == check[1::2]).all()
    _, _, again, same = _shingles(batch, WORDS, np.sort(ids[:2]))
    assert (again[2:] == ids[2:]).all() and again[0] == again[1] != ids[0] and (same == check).all()


def test_rows_without_an_id_are_not_gathered(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.range(0, 400, 1, 4).select(F.when(F.col("id") < 2, F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    got = substring_dedup(df).withColumn("part", F.spark_partition_id()).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in got} == {(0, 30, 0), (1, 30, 30), (None, 30, 0)} and len(got) == 400
    assert len({r["part"] for r in got if r["doc_id"] is None}) == 4


def test_substring_dedup(docs, texts, empty):
    least = {}
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - 12):
            q = tuple(w[k : k + 13])
            least[q] = min(i, least.get(q, i))
    got = substring_dedup(docs, with_columns=True)
    assert {"lang", "source", "score"} <= set(got.columns) and substring_dedup(empty).count() == 0
    removed = 0
    for r in got.collect():
        if r["doc_id"] is None:
            assert r["n_removed"] == 0 and r["n_words"] == len(words[8])
            continue
        w, gone = words[r["doc_id"]], set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < r["doc_id"]:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        removed += len(gone)
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert removed > 100


def test_substring_dedup_keeps_columns_where_they_are_and_long_texts_whole(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [("x", " ".join(words), 1, 0.5), ("y", "new " + " ".join(words[1000:2000]) + " end", 2, None), (None, "a " * 2_000_000, 3, 1.0), ("z", "", 4, 1.0), ("n", None, 5, 1.0), ("same id", " ".join(words[:20]), 1, 0.0), ("no id", " ".join(words[:20]), None, 0.0)]
    df = spark.createDataFrame(rows, "source string, text string, doc_id long, marks double")
    got = {r["source"]: r for r in substring_dedup(df, with_columns=True).collect()}
    assert {k: (r["doc_id"], r["text"]) for k, r in got.items()} == {s: (i, t) for s, t, i, _ in rows}
    assert {k: r["n_removed"] for k, r in got.items()} == {"x": 0, "y": 1000, None: 0, "z": 0, "n": 0, "same id": 0, "no id": 0}
    assert got["y"]["kept_text"] == "new end" and got["n"]["kept_text"] == "" and got[None]["n_words"] == 2_000_000


def test_windows_of_one_key_are_told_apart_by_their_checks():
    from quillbank.llm.substring_dedup import _grouped

    rng = np.random.default_rng(3)
    keys, checks, owners = (rng.integers(0, n, 400) for n in (20, 3, 9))
    keys, checks = keys.astype(np.uint64), checks.astype(np.uint64)
    least, first = _grouped(keys, checks, owners)
    seen = set()
    for i, w in enumerate(zip(keys.tolist(), checks.tolist())):
        mine = [o for k, c, o in zip(keys.tolist(), checks.tolist(), owners.tolist()) if (k, c) == w]
        assert least[i] == min(mine)
        if first[i]:
            assert owners[i] == min(mine) and w not in seen
            seen.add(w)
    assert len(seen) == len(set(zip(keys.tolist(), checks.tolist())))


def test_quality_classifier_learns_and_survives_edges(spark, docs, empty):
    rng = random.Random(2)
    good = [" ".join(rng.choices(["the", "river", "house", "goes", "with"], k=60)) for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" if rng.random() < 0.5 else w for w in t.split()) for t in good]
    rows = [(2 * i + k, t) for i, pair in enumerate(zip(good, bad)) for k, t in enumerate(pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    net = fit(df, labels)
    out = score_quality(df, net).where("held_out").collect()
    assert len(out) > 10 and np.mean([(r["score"] > 0.5) == (r["doc_id"] % 2 == 0) for r in out]) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    edge = score_quality(docs, net, with_columns=True).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge) and score_quality(empty, net).count() == 0
    assert fit(df, labels.limit(0)).offset == 0.0 and train(["a"], [1]).offset > 0


def test_quality_scores_of_long_texts_do_not_depend_on_parts():
    net = train(["aaaa bbb" * 40, "ccc ddd!" * 40] * 8, [1, 0] * 8, epochs=2)
    data = np.frombuffer(("some words go here, " * 3000).encode(), np.uint8)
    bounds = np.array([0, 10, 10, len(data)])
    assert np.allclose(scores(net, data, bounds), scores(net, data, bounds, rows_at_once=7), atol=1e-6)


def _plain_score(net, text):
    """The network by its definition, one chunk and one window at a time."""
    data = (text or "").encode()
    responses = []
    for start in range(0, max(1, len(data) - OVERLAP), CHUNK - OVERLAP):
        chunk = [*data[start : start + CHUNK]]
        chunk += [256] * (CHUNK - len(chunk))
        best = np.full(FILTERS, -np.inf)
        for at in range(0, CHUNK - WIDTH + 1, STRIDE):
            shown = np.concatenate([net.table[b] for b in chunk[at : at + WIDTH]]).astype(np.float64)
            best = np.maximum(best, shown @ net.filters.astype(np.float64))
        responses.append(np.maximum(best + net.bias, 0))
    pooled = np.concatenate([np.max(responses, axis=0), np.mean(responses, axis=0)])
    return 1 / (1 + np.exp(-(pooled @ net.weights + net.offset)))


def test_quality_scores_equal_a_plain_forward_pass(spark):
    rng = random.Random(17)
    net = train(["aaaa bbb" * 40, "ccc ddd!" * 40] * 8, [1, 0] * 8, epochs=2)
    texts = {i: "".join(rng.choices("abcd !é漢", k=n)) for i, n in enumerate([0, 1, 7, 8, 9, 200, 247, 248, 249, 256, 257, 504, 505, 3000])}
    texts[50], texts[51] = None, "some words and a bbb go here " * 25_000  # the last goes through Spark in parts
    got = {r["doc_id"]: r["score"] for r in score_quality(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), net).collect()}
    for i, t in texts.items():
        if i != 51:
            assert got[i] == pytest.approx(_plain_score(net, t), abs=1e-5)
    data = np.frombuffer(texts[51].encode(), np.uint8)
    assert got[51] == pytest.approx(float(scores(net, data, np.array([0, len(data)]), rows_at_once=10**6)[0]), abs=1e-5)


def test_exact_topk(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = rng.normal(0, 1, 6) * rng.choice([0.2, 1, 3])
        rows.append((i, [float(x) for x in (rows[i - 1][1] if i % 9 == 1 else v)], 0, 0))
    rows[17] = (17, None, 0, 0)
    rows[18] = (18, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 0)
    rows[19] = (19, [float("nan")] * 6, 0, 0)
    rows[20] = (20, [float("inf")] * 6, 0, 0)
    rows += [(401, [1.0, 2.0], 0, 0), (500, [3.0, 4.0], 0, 0), (600, [], 0, 0), (None, [1.0] * 6, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score int").repartition(3)
    sound = {i: np.floor(1024 * np.array(v)).astype(int) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in sound if i % 20 == 0):
        scored = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
        for rank, (s, i) in enumerate(scored[:10], 1):
            want[q, rank] = i, -s
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk(df, df.where("vec_id % 20 = 0"), bucket_rows=50).collect()}
    assert got == want
    assert exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_prunes_by_length_coordinate_and_bucket():
    from quillbank.llm.exact_topk import Bucket, _best

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 8))
    near = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.02, (4000, 8))
    near = np.floor(1024 * near / np.linalg.norm(near, axis=1)[:, None])  # lengths are nearly one
    spread = rng.normal(0, 1, (4000, 8))
    spread = np.floor(1024 * spread / np.linalg.norm(spread, axis=1)[:, None] * rng.uniform(1, 3, 4000)[:, None])
    for rows, wanted in ((near, "coordinate"), (spread, "length")):
        ids, counts = np.arange(len(rows)), {}
        order = np.argsort(-np.linalg.norm(rows, axis=1), kind="stable")
        tables = [Bucket(ids[x], rows[x]) for x in np.split(order, 8 if wanted == "coordinate" else 2)]
        queries = ids[::100]
        own = np.linalg.norm(rows[queries], axis=1)
        best = {i: (np.zeros(0, int), np.zeros(0, int)) for i in range(len(queries))}
        floors = np.full(len(queries), -np.inf)
        for table in tables:
            for i, some, scores in table.search(queries, rows[queries], own, floors, 10, counts):
                some, scores = np.concatenate([best[i][0], some]), np.concatenate([best[i][1], scores])
                at = _best(some, scores, 10)
                best[i] = some[at], scores[at]
                if len(at) == 10:
                    floors[i] = scores[at].min()
        exact = (rows[queries] @ rows.T).astype(int)
        for i, q in enumerate(queries):
            other = ids[ids != q]
            at = _best(other, exact[i][other], 10)
            assert best[i][0].tolist() == other[at].tolist() and best[i][1].tolist() == exact[i][other[at]].tolist()
        assert counts[wanted] > 5000 and counts["verified"] < 0.6 * len(queries) * len(rows), counts
        assert wanted == "length" or counts["bucket"] > 0


def test_exact_topk_of_many_buckets_and_groups(spark):
    import duckdb

    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    rng = np.random.default_rng(6)
    rows += [(100_000 + i, (np.array(v) * rng.lognormal(0, 0.7)).tolist()) for i, v in rows]
    v = {i: np.floor(1024 * np.array(x, float)).astype(int) for i, x in rows}
    matrix, ids = np.array(list(v.values())), np.array(list(v))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for group_bytes in (1, 1 << 17):
        got = defaultdict(list)
        for r in exact_topk(df, df.where("vec_id % 100 = 0"), bucket_rows=64, group_bytes=group_bytes).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert set(got) == {i for i in v if i % 100 == 0}
        for q, found in got.items():
            scores = matrix @ v[q]
            order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:10]
            assert found == [(int(ids[k]), int(scores[k])) for k in order]


def test_sainte_lague_equals_highest_quotients():
    rng = random.Random(6)
    for _ in range(50):
        wanted = [float(rng.choice([0, 1, 7, 7, 100, rng.random() * 50])) for _ in range(rng.randint(1, 8))]
        seats = rng.randint(0, 60)
        ranked = sorted(((-x / (2 * k + 1), i) for i, x in enumerate(wanted) for k in range(seats) if x > 0))[:seats]
        plain = [sum(1 for _, i in ranked if i == j) for j in range(len(wanted))]
        got = sainte_lague(wanted, seats)
        assert sum(got) == sum(plain)
        assert sorted(w / (2 * k + 1) for w, g in zip(wanted, got) for k in range(g)) == pytest.approx(sorted(-q for q, _ in ranked))


def test_targets_share_all_and_stop_at_the_cap():
    assert targets([10, 10, 980]) == [30.0, 30.0, 940.0] and targets([]) == [] and targets([0, 5]) == [0.0, 5.0]
    assert sum(targets([100, 200, 300, 400])) == pytest.approx(1000)


def test_mixing(docs, texts, empty):
    got = mixed_sizes(docs, block=8).collect()
    assert len(got) == docs.count() and mixed_sizes(empty).count() == 0 and mix_sources(empty).count() == 0
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert r["size"] == len(WORD.findall(texts[8 if r["doc_id"] is None else r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] = r["target"]
        by[r["source"]][2] += r["taken"]
    assert sum(x[1] for x in by.values()) == pytest.approx(sum(x[0] for x in by.values()))
    for size, target, taken in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 16 + 0.01 * target
    again = {(r["doc_id"], r["taken"]) for r in mixed_sizes(docs, block=8).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    mix = mix_sources(docs, block=8)
    assert mix.columns == docs.columns
    words = sum(len(WORD.findall(r["text"])) for r in mix.collect())
    assert words == sum(r["taken"] for r in got)


def test_mixing_places_every_word_as_a_plain_version(spark):
    """Taken words, word by word: from the blocks of each shard that mixed_sizes() says are chosen."""
    rng = random.Random(15)
    rows = [(i % 50 if i % 9 else None, ["a", "b", None][i % 3] if i < 200 else "tiny", " ".join(f"w{i}x{k}" for k in range(rng.choice([0, 1, 7, 30])))) for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = mixed_sizes(df, block=4).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    order = ["a", "b", "tiny", None]
    target = dict(zip(order, targets([sizes[s] for s in order])))
    taken = defaultdict(int)
    for r in got:
        assert (r["source_size"], r["target"]) == (sizes[r["source"]], pytest.approx(target[r["source"]]))
        inside = sum(any((b - r["phase"]) % r["blocks"] < r["chosen"] for b in [(r["begin"] + k) // r["block"]]) for k in range(r["size"]))
        assert r["taken"] == r["full"] * r["size"] + inside <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        here = sorted((r["begin"], r["size"]) for r in got if r["source"] == s and r["size"])
        assert all(a + n == b for (a, n), (b, _) in zip(here, here[1:])) and here[0][0] == 0  # one shard a source here
        assert abs(taken[s] - target[s]) <= 4 + 0.02 * target[s]
    whole = {t for _, _, t in rows}
    texts = [r["text"] for r in mix_sources(df.withColumn("__row", F.lit(1)), block=4).collect()]
    assert sum(len(t.split()) for t in texts) == sum(taken.values()) and sum(t not in whole for t in texts) <= 8  # few are cut


def test_shard_quotas_equal_highest_quotients(spark):
    rng = random.Random(16)
    rows, want = [], {}
    for s in ("a", None, "c", "d"):
        words = [rng.choice([0, 1, 5, 5, 1000, rng.randrange(1, 300)]) for _ in range(40)] if s != "d" else [10**6] + [3] * 60
        quota = rng.randrange(0, 400) if s != "d" else 5000
        rows += [(s, i, w, quota) for i, w in enumerate(words)]
        want[s] = sorted(((-w / (2 * k + 1), i) for i, w in enumerate(words) for k in range(quota) if w))[:quota]
    got = defaultdict(dict)
    for r in shard_quotas(spark.createDataFrame(rows, "source string, shard int, words long, quota long")).collect():
        got[r["source"]][r["shard"]] = r["seats"]
    for s, ranked in want.items():
        assert [got[s][i] for i in sorted(got[s])] == [sum(j == i for _, j in ranked) for i in sorted(got[s])]


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><li>n{i}</li></nav><div class="ad x">buy {i}</div>
<div id=top><p>Welcome to us</p></div><article><h1>T{i} &amp; co</h1><p><b>one {i}<br>two&nbsp; three<p>four<ul><li>a<li>b</ul>
<p>Share this<aside>side</aside><form>f</form></article><section class="comments"><p>c{i}</p></section><footer>f</footer></body></html>"""


def test_main_text_and_wrapper_induction(spark):
    rows = [(i, "http://A.example.com/x", PAGE.replace("{i}", str(i))) for i in range(8)]
    rows += [(50, "http://b.example.com", "<p>plain<p>text"), (51, None, None), (52, "x", ""), (53, "http://c.example", "no tags &lt;b&gt; <"), (3, "http://a.example.com/", rows[3][2])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(3)
    got = {r["page_id"]: r for r in extract_main_text(df).collect()}
    assert got[4]["text"] == "T4 & co\none 4 two three\nfour"  # the blocks that all pages have are template
    assert got[50]["text"] == "plain\ntext" and got[51]["text"] == "" and got[52]["n_chars"] == 0 and got[53]["text"] == "no tags <b> <"
    assert extract_main_text(df).count() == len(rows) and extract_main_text(df.limit(0)).count() == 0
    assert main_text(PAGE.replace("{i}", "4")) == "T4 & co\none 4 two three\nfour\na\nb\nShare this"
    copies = spark.createDataFrame([(i, "http://d.example/", rows[0][2]) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in extract_main_text(copies).collect()} == {main_text(rows[0][2])}


def test_wrapper_induction_keeps_other_bodies_and_copies(spark):
    page = "<nav><p>menu {i}</p></nav><div class=ad>buy {i}</div>{a}<p>{x}<p>{y}{z}"
    stub, other = ("this text was removed", "ask its author"), ("a body of its own", "and more of it")
    rows = []
    for host, a, z in (("a", "<article>", "</article>"), ("b", "<div>", "</div>"), ("c", "<article><h1>t{i}</h1>", "</article>")):
        for i in range(10):
            x, y = other if i == 7 else stub
            rows.append((len(rows), f"http://{host}.example/{i}", page.format(i=i, a=a.format(i=i), x=x, y=y, z=z)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    for i in range(30):
        body = "\n".join(other if i % 10 == 7 else stub)
        assert got[i] == (f"t{i % 10}\n{body}" if i >= 20 else body)


def test_class_words_do_not_drop_whole_articles():
    kept = (
        '<html class="js cookies"><body class="no-sidebar"><p>text</body>',
        '<body><div id="content" class="with-sidebar"><p>text</div>',
        '<body><div id="content" class="sidebar-left"><p>text</div>',
        '<article class="post comments-open"><p>text</article>',
        '<article><div class="article-header"><h1>text</h1></div></article>',
        '<article><div class="header"><h1>text</h1></div></article>',
        '<div class="widget"><article><p>text</article></div>',
        '<div class="sidebar"><div><main><p>text</main></div></div>',
        '<div class="navbar-fixed"><body><p>text</body></div>',
        '<div class="widget"><div><article><p>text</article></div></div>',
    )
    assert [main_text(x) for x in kept] == ["text"] * len(kept)
    gone = ('<div class="ad-slot"><p>x</div>', '<div class="x sidebar"><p>x</div>', '<div id="comments"><article class="comment"><p>x</article></div>', '<div class="share_buttons">x</div>')
    assert [main_text(f"<article><p>text</article>{x}") for x in gone] == ["text"] * len(gone)
    assert [main_text(f"<p>text</p>{x}") for x in (gone[0], gone[1], gone[3])] == ["text"] * 3
    assert main_text(f"<p>text</p>{gone[2]}").startswith("text")


def test_tree_matching_against_plain_recursion():
    def plain(a, b):
        if a[0] != b[0]:
            return 0

        def best(x, y):
            if not x or not y:
                return 0
            return max(best(x[1:], y), best(x, y[1:]), plain(x[0], y[0]) + best(x[1:], y[1:]))

        return 1 + best(a[1], b[1])

    rng = random.Random(8)

    def tree(depth):
        return [rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]

    for _ in range(40):
        a, b = tree(3), tree(3)
        assert tree_match(a, b)[0] == plain(a, b) == sum(n >= 0 for n in _numbers(a, b))
    page, _ = parse("<div><p>a<p>b<div><p>c</div></div>")
    assert skeleton(page) == ["", [["div.", [["p.", []], ["div.", [["p.", []]]]]]]]


def test_longest_match(spark, docs, texts, empty):
    rng = random.Random(9)
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "abc", "cab", "bcd", "abcde", "d", "▁w1", "w", "1", "é漢"]
    known, longest = set(pieces), max(map(len, pieces))

    def naive(w):
        i = n = 0
        while i < len(w):
            j = next((j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in known), None)
            n, i = (n + 1, j) if j else (n + len(w[i].encode()), i + 1)
        return n

    matcher = LongestMatch(pieces)
    for _ in range(3000):
        w = "▁" * (rng.random() < 0.5) + "".join(rng.choices("abcdeé漢", k=rng.randint(0, 14)))
        assert matcher.count(w) == naive(w)
    for r in token_counts(docs, pieces).collect():
        words = WORD.findall(texts[8 if r["doc_id"] is None else r["doc_id"]] or "")
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(naive("▁" + w) for w in words))
    assert token_counts(empty, pieces).count() == 0


def test_plan_packing_places_every_piece_once():
    rng = random.Random(10)
    for capacity in (10, 64):
        for _ in range(40):
            counts = {n: rng.randint(0, 9) for n in range(1, capacity + 1) if rng.random() < 0.6}
            seen, fill = defaultdict(int), defaultdict(list)
            for length, rank, pieces, sequence, per, offset in plan_packing(counts, capacity):
                assert rank == seen[length]
                seen[length] += pieces
                for k in range(pieces):
                    fill[sequence + k // per].append((offset + k % per * length, length))
            assert dict(seen) == {n: c for n, c in counts.items() if c}
            for spans in fill.values():
                end = 0
                for at, length in sorted(spans):
                    assert at == end
                    end += length
                assert end <= capacity
            total = sum(n * c for n, c in counts.items())
            above_half = sum(c for n, c in counts.items() if 2 * n > capacity)
            assert len(fill) <= max(above_half, 1.25 * total / capacity) + 2
    assert plan_packing({}) == []
    with pytest.raises(ValueError):
        plan_packing({0: 1})


def test_held_words_are_forgotten_by_use_and_ids_stay_right(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillbank.llm import best_fit_packing

    monkeypatch.setattr(best_fit_packing, "_WORDS_HELD", 60)
    rng, tokenizer = random.Random(22), Tokenizer.from_file(vocabulary_path())
    held = best_fit_packing.WordIds(vocabulary_path())
    for _ in range(12):
        texts = [" ".join(["the", "of", *(f"w{rng.randrange(200)}é" for _ in range(rng.randint(0, 30)))]) for _ in range(3)] + [None, "", " "]
        ids, bounds = best_fit_packing.document_ids(held, pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
    assert len(held.at) == len(held.uses) == len(held.begin) - 1 < 200 and held.uses.max() > 3


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    got = best_fit_packing(docs, capacity=512).collect()
    assert best_fit_packing(empty).count() == 0
    want, fill = defaultdict(int), defaultdict(list)
    for i in [*texts, 7, None]:
        ids = tokenizer.encode(texts[8 if i is None else i] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[i, k // 512, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    have = defaultdict(int)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for spans in fill.values():
        assert [a for a, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 512


def test_parsing_of_odd_and_very_long_pages():
    text = lambda x: main_text(x).split("\n")
    assert text("<article><p>a<svg/><p>b<svg><path/>x</svg><p>c</article>") == ["a", "b", "c"]
    assert text("<p>a<iframe src=x><p>b<iframe>in</iframe>c") == ["a", "b", "c"] and text("<p>a<iframe src=x><p>b") == ["a", "b"]
    assert text("<article><p>see <math><mi>x</mi><mo>=</mo><mn>2</mn></math> there<blockquote><p>q</p><footer>who</footer></blockquote></article>") == ["see x=2 there", "q", "who"]
    assert text("<title>t<p>a") == ["t", "a"] and text("<head><title>t</title><body><p>a") == ["a"]
    assert text("<p title=it's>it isn't</p><p title='a>b'>c</p>") == ["it isn't", "c"] and main_text("a < b & c > d") == "a < b & c > d"
    assert text("<script>var a = '<p>';") == [""] and text("<div class=related-content><p>" + "a " * 50 + "</div><p>b")[0].startswith("a a")
    deep = main_text("<div>" * 3000 + "x" + "</div>" * 3000 + "<p>y")
    assert deep == "x\ny"
    root, _ = parse("<div>" * 3000 + "x")
    assert _numbers(skeleton(root), skeleton(root))[0] == 0
    from time import perf_counter

    began = perf_counter()
    assert main_text("<a " * 350_000).startswith("<a <a") and main_text("<a " * 350_000 + '="' + ">" + '"') is not None
    assert main_text("<li>" * 100_000 + "x") == "x" and main_text("<td><ul>" + "<div>" * 100_000 + "<td>" * 1000 + "x") == "x"
    alternating = "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(1000))
    root, _ = parse(alternating)
    assert len(skeleton(root)[1]) == 2 and len(main_text(alternating, json.dumps(skeleton(root)), {9: ""}).split("\n")) == 2000
    odd = "".join(f'<div class="c{i}"><b>x</b></div>' for i in range(5000))
    root, _ = parse(odd)
    assert max(_numbers(skeleton(root), skeleton(root))) < 1024 and len(text(odd)) == 5000
    assert perf_counter() - began < 30


def test_copies_of_one_story_with_another_date_keep_it(spark):
    page = "<nav><p>menu</nav><article><p>{i} March</p><p>the story</p><p>and its end</p></article><footer>f</footer>"
    rows = [(i, "http://a.example/", page.replace("{i}", str(i))) for i in range(10)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{i} March\nthe story\nand its end" for i in range(10)}


def test_the_wrapper_alone_finds_the_content(spark):
    """Rotating adverts, menus of links and constant notices go without any hint of element names or classes."""
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choices([f"w{i}" for i in range(500)], k=n))
    adverts, menus = [words(8) for _ in range(6)], [[words(1) for _ in range(4)] for _ in range(50)]
    rows, want = [], {}
    for i in range(60):
        body = [words(30) for _ in range(rng.randint(1, 6))]
        menu = "".join(f"<li><a href=x>{x}</a>" for x in rng.choice(menus))
        other = i % 3 == 0  # a second layout of the host
        rows.append((i, "http://a.example/", f"<div><ul>{menu}</ul></div><div class=q>{rng.choice(adverts)}</div>" + "".join(f"<p>{x}" for x in body) + ("<section><table><td>same words" if other else "<div>the same")))
        want[i] = "\n".join(body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r["page_id"]: r["text"] for r in extract_main_text(df, hints=False).collect()} == want
    off = {r["page_id"]: r["text"] for r in extract_main_text(df, least_pages=1000, hints=False).collect()}
    assert all(off[i] != want[i] and want[i] in off[i] for i in want)
