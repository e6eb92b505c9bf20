"""Operators on documents against plain versions, and on hard rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from momenta.llm import decontaminate, line_dedup, mixing, pii, quality, queries, simhash, token_counts, token_files
from tests.compare import both
from tests.conftest import SMALL
from tests.llm.cases import hard_docs, no_docs, words

WORD_BPE, PIECES = (queries.tokenizer_path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got, expected = both(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, SMALL)
    assert got == expected


OPERATORS = {
    "line_dedup": line_dedup.dedup_lines,
    "pii": pii.pseudonymize,
    "mixing": mixing.mix,
    "token_counts": lambda d: token_counts.count_tokens(d, PIECES, chunk=1000),
    "token_files": lambda d: token_files.encode(d, WORD_BPE),
    "quality": quality.rate,
    "simhash": simhash.near_duplicates,
    "decontaminate": lambda d: decontaminate.report(d, bench(d.sparkSession)),
}


def bench(spark):
    return spark.createDataFrame([("i1", "b c d e f g h i j k l m n", 1), ("i2", "Same TEXT", 2), ("i2", "same text", 3), (None, "x", 4), ("i3", None, 5), ("i4", " ", 6)], "item_id string, text string, doc_id int")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(spark, name):
    docs = hard_docs(spark)
    got = OPERATORS[name](docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_repeated_rows_agree(spark, name):
    """The two rows of a repeated document have one result, but for their places in files; equal texts under two ids have equal counts."""
    rows = collections.defaultdict(list)
    for r in OPERATORS[name](hard_docs(spark)).collect():
        rows[r.doc_id].append({k: v for k, v in r.asDict(recursive=True).items() if k not in ("start", "file", "place")})
    for doc in (0, 3):
        first, second = rows[doc]
        assert first == second
    if name not in ("line_dedup", "mixing"):
        a, b = ({k: v for k, v in rows[d][0].items() if k not in ("doc_id", "distance", "kept")} for d in (4, 5))
        assert a == b


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](no_docs(spark)).collect() == []


def test_line_dedup_by_hand(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\n\nb\nc\ny"), (3, "b\nc\nd\ne"), (4, "a\nb"), (5, "q\nq\nq\nq")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == "a\nb\nc\nd"
    assert got[2].text == "x\ny" and got[2].n_lines == 5 and got[2].n_removed == 3 and [tuple(s) for s in got[2].spans] == [(1, 4)]
    assert got[3].text == "e" and got[4].text == "a\nb"
    assert got[5].text == "q" and got[5].n_removed == 3


def plain_quality(text):
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(hard_docs(spark).where("doc_id < 100").select(F.col("doc_id") + 10_000, "text", "lang", "source").toDF("doc_id", "text", "lang", "source"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.rate(docs).collect():
        n = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)


def test_quality_distance_is_mahalanobis(spark):
    """The distances are those of numpy with the estimated centre and factor."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, quality.D))
    x[:30] += 50
    rows = spark.createDataFrame([(None, "s", *map(float, v)) for v in x], f"g_0 string, g_1 string, {', '.join(f'{n} double' for n in quality.NAMES)}")
    p = quality.estimate(rows).first()
    m = np.array([p[f"m_{i}"] for i in range(quality.D)])
    c = np.array([[p[f"c_{i}_{j}"] if j <= i else 0 for j in range(quality.D)] for i in range(quality.D)])
    assert np.abs(m).max() < 0.5  # the thirty far rows don't move the centre
    got = sorted(r.d for r in quality._with(rows, quality.estimate(rows)).select(quality._distance().alias("d")).collect())
    assert np.allclose(got, np.sort((np.linalg.solve(c, (x - m).T) ** 2).sum(axis=0)))
    assert quality.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert quality.chi2_quantile(0.99, 6) == pytest.approx(16.81189, abs=1e-4)


def test_quality_estimate_is_the_least_determinant(spark):
    """Against all subsets of nine of twelve rows: the estimate's determinant is the least one, but for a local one now and then, never one below."""
    rng = np.random.default_rng(0)
    least_dev = np.array([w for _, _, w in quality.VECTOR])
    scale = quality.CORE / quality.chi2_cdf(quality.chi2_quantile(quality.CORE, quality.D), quality.D + 2)
    rows, want = [], {}
    for g in range(12):
        x = rng.normal(0, 1, (12, quality.D)) @ rng.normal(0, 1, (quality.D, quality.D)) * least_dev * 3
        x[: g % 4] += least_dev * rng.normal(20, 5, quality.D)
        rows += [(str(g), None, *map(float, v)) for v in x]
        cov = lambda s: scale * np.cov(x[list(s)].T, bias=True) + np.diag(least_dev**2)  # noqa: E731, B023
        want[str(g)] = min(np.linalg.slogdet(cov(s))[1] / 2 for s in itertools.combinations(range(12), 9))
    df = spark.createDataFrame(rows, f"g_0 string, g_1 string, {', '.join(f'{n} double' for n in quality.NAMES)}")
    got = {r.g_0: sum(np.log(r[f"c_{i}_{i}"]) for i in range(quality.D)) for r in quality.estimate(df).collect()}
    gaps = [got[g] - want[g] for g in want]
    assert min(gaps) > -1e-6 and sum(d < 1e-6 for d in gaps) >= 9


def test_quality_keeps_clean_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.rate(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in r}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_quality_drops_symbols_among_constant_texts(spark):
    """A text with 8.4 % symbols in a group that has none lies beyond the chi-square's tail of 1e-4."""
    texts = [" ".join(f"w{chr(97 + i)}{k:03}" for k in range(100)) for i in range(20)]
    texts.append(" ".join("#" + w[1:] if k < 42 else w for k, w in enumerate(texts[0].split(" "))))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.rate(docs).collect()}
    assert kept == {i: i < 20 for i in range(21)}


def test_fingerprints_and_components(spark):
    xxh = pytest.importorskip("xxhash")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def plain(text):
        w = words((text or "").translate(lower))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxh.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {r.doc_id: plain(texts[r.doc_id]) for r in got}
    assert all(r.fp & (1 << 64) - 1 == fps[r.doc_id] for r in got)
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert all(r.component_id == find(r.doc_id) for r in got)


def test_links_of_a_dense_cluster(spark):
    """A ball of near fingerprints, a chain, and far ones: linked exactly, by far fewer edges than pairs."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    ball = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))}
    chain = [0b111 << 3 * i if i % 2 else 0 for i in range(4)]
    fps = sorted(ball | set(chain) | {int(x) for x in rng.integers(1 << 62, size=200)})
    from momenta.llm.common import components

    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert edges.count() < 64 * len(fps)
    label = {r.node: r.root for r in components(edges).collect()}
    near = lambda a, b: (a ^ b).bit_count() <= 3
    seen, groups = set(), 0
    for f in fps:
        if f in seen:
            continue
        groups += 1
        todo, part = [f], {f}
        while todo:
            x = todo.pop()
            new = {y for y in fps if y not in part and near(x, y)}
            part |= new
            todo += new
        seen |= part
        assert len({label.get(x, x) for x in part}) == 1
    assert len({label.get(x, x) for x in fps}) == groups


def test_links_of_split_keys(spark):
    """Many fingerprints with one half in common: split keys link what whole keys link."""
    from momenta.llm.common import components

    rng = np.random.default_rng(3)
    halves = [int(x) for x in rng.integers(2**31, size=2)]
    fps = set()
    for k in range(600):
        f = halves[k % 2] << 32 | int(rng.integers(2**32)) if k % 3 else int(rng.integers(2**31)) << 32 | halves[k % 2]
        fps |= {f, f ^ sum({1 << int(j) for j in rng.integers(0, 63, 3)})}
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    groups = []
    for hot in (simhash.HOT, 20):
        parts = collections.defaultdict(set)
        for r in components(simhash.links(df, hot=hot)).collect():
            parts[r.root].add(r.node)
        groups.append(sorted(map(sorted, parts.values())))
    assert groups[0] == groups[1] and len(groups[0]) > 100
    assert simhash._hot_keys(df, simhash.HOT).isEmpty() and not simhash._hot_keys(df, 20).isEmpty()


def plain_mix(docs):
    size = [len(words(t)) for _, t, _ in docs]
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, s))
    total = {n: sum(z for z, (*_, s) in zip(size, docs) if s == n) for n in names}
    weight, capped = {n: 1 + i % 3 for i, n in enumerate(names)}, {}
    while True:
        rest = sum(total.values()) - sum(capped.values())
        free = [n for n in names if n not in capped]
        target = {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n: 3 * total[n] for n in free if target[n] > 3 * total[n]}
        if not over:
            return {**capped, **target}, total
        capped |= over


def test_mixing_targets_and_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()] + [(10_000 + i, "word " * 900, None) for i in range(3)] + [(20_000, "tiny", "a0"), (20_001, "", "a1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    target, total = plain_mix(rows)
    source = {d: s for d, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    largest = collections.Counter()
    for d, t, s in rows:
        largest[s] = max(largest[s], len(words(t)))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sorted(got) == sorted(mixing.mix(df.repartition(5)).collect())
    mixed = mixing.take_mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


@pytest.fixture(scope="module")
def nasty():
    import random

    rng = random.Random(2)
    some = [*"aAbBéÉİßΣςσ\t\r\n  '漢字🎉\x1c\x85１ﬁ<>|.,!0123▁", "the", " and", "don't", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "é", "한국", "10000", "====", "    "]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(1500)]


def test_token_counts_are_the_librarys(spark, nasty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = nasty + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + ["the quick brown fox " * 500, "z" * 3000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (token_counts.CHUNK, 7):
        got = {r.doc_id: r for r in token_counts.count_tokens(df.where("length(text) < 5000 or text is null") if chunk == 7 else df, PIECES, chunk=chunk).collect()}
        for i, r in got.items():
            n = len(lib.encode(texts[i] or "", num_threads=1))
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[i] or "").encode()), n > 4096)


def test_chunk_maps_compose_in_any_order(nasty):
    counts = token_counts.load_once(PIECES)
    for text in nasty[:300]:
        if text:
            t = token_counts.SPACE + text.replace(" ", token_counts.SPACE)
            maps = [token_counts.chunk_map(t[k : k + 3], counts) for k in range(0, len(t), 3)]
            left = maps[0]
            for m in maps[1:]:
                left = token_counts.compose(left, m, counts)
            right = maps[-1]
            for m in maps[-2::-1]:
                right = token_counts.compose(m, right, counts)
            want = token_counts.text_tokens(text, counts)
            assert token_counts.finish(left, counts) == token_counts.finish(right, counts) == token_counts.finish(token_counts.scan(maps, counts)[-1], counts) == want


def test_long_texts_without_blanks_compose(spark):
    """Texts without blanks, of one pattern again and again, and of many scripts: any chunk size gives the library's counts."""
    import random

    import sentencepiece

    lib, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123+/") for _ in range(9000)), "漢字한국的是不了" * 900, "=" * 7001, "ab-" * 2500, " " * 3000 + "x" * 3000, "the end " * 800 + "z" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (1 << 9, 1000, 64):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PIECES, chunk=chunk).collect()}
        assert got == {i: len(lib.encode(t, num_threads=1)) for i, t in enumerate(texts)}
    ones = df.where("doc_id = 3").withColumn("text", F.substring("text", 1, 900))
    assert token_counts.count_tokens(ones, PIECES, chunk=1).first().n_tokens == len(lib.encode(texts[3][:900], num_threads=1))


def test_maps_stay_small():
    counts = token_counts.load_once(PIECES)
    for text in ("q7Z" * 300_000, "=" * 500_000, "word " * 100_000):
        maps = [token_counts.chunk_map(text[k : k + 50_000].replace(" ", token_counts.SPACE), counts) for k in range(0, len(text), 50_000)]
        whole = maps[0]
        for m in maps[1:]:
            whole = token_counts.compose(whole, m, counts)
        assert len(repr(whole)) < 20_000


def test_token_files_round_trip(spark, nasty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD_BPE)
    texts = nasty + [None, "", "word " * 5000]
    df = spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = token_files.write(df, WORD_BPE, f"file://{tmp_path}/t", sequence=64)
    got = {r.doc_id: r for r in token_files.read(index).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[7 * i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    # sequences are views of the mapped file, and masks say what is filling
    total = 0
    for file in {r.file for r in index.collect()}:
        reader = token_files.SequenceReader(file)
        n = sum(reader.file.get_batch(k).num_rows for k in range(reader.file.num_record_batches))
        for k in range(n):
            ids, mask = reader.sequence_at(k)
            assert len(ids) == 64 and not ids.flags.owndata and not ids.flags.writeable
            total += int(np.unpackbits(mask, bitorder="little").sum())
    assert total == start


def plain_hits(doc, items):
    w = decontaminate.words(doc)
    hit, found = set(), set()
    for name, text in items:
        v = decontaminate.words(text)
        n = min(len(v), 13)
        if not n:
            continue
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(name)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination_against_loops(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(rng.choice(["a", "b", "C", "é"], n))
    items = [(f"i{k}", draw(int(rng.integers(1, 40)))) for k in range(25)] + [("dup", "a b"), ("none", "")]
    docs = [(i, draw(int(rng.integers(0, 120)))) for i in range(60)] + [(100, items[3][1]), (101, f"Z {items[4][1].upper()}!")]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for block in (decontaminate.BLOCK_BYTES, 200):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(df, b) .collect()} if block != 200 else {r.doc_id: r for r in decontaminate.matches(df, b, block_bytes=block).collect()}
        for i, t in docs:
            want = plain_hits(t, items)
            if block == 200:
                r = got[i]
                assert r.n_words == want[0] and len(r["items"]) == want[2] and sum(r.spans[1::2]) - sum(r.spans[::2]) == want[1]
            else:
                assert got[i] == want


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "p q x y"), (2, "a b"), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "x"), (None, "q x"), ("i", "a b")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(docs, items).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {1: (2, 1, sha(b"")), 2: (2, 1, sha(b"i")), 3: (1, 1, sha(b""))}


def test_longest_matches():
    items = decontaminate.build_items([("x", "a b c d e"), ("y", "c d q")], window=3)
    shard = decontaminate.Shard(["z a b c d z", "c d e"], items)
    longest, where, first, last = decontaminate.search(shard.text, shard.order, items)
    assert longest.tolist() == [4, 3, 3, 2, 1, 2, 1, 0]
    assert (last - first).tolist()[:3] == [1, 1, 1]


def test_longest_matches_of_a_table(spark):
    docs = spark.createDataFrame([(5, "z a b c d z"), (3, "c d e"), (4, "C, d. e"), (9, None)], "doc_id long, text string")
    bench_ = spark.createDataFrame([(1, "a b c d e"), (2, "c d q"), (3, "d e")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.longest_matches(docs, bench_, window=3).collect())
    assert got == [("1", 0, 4, 5, 1), ("1", 1, 3, 5, 2), ("1", 2, 3, 3, 0), ("3", 0, 2, 3, 1)]


def test_surrogates(spark):
    rows = [
        (1, 'Mail john.Doe@Mail-3.example.co.uk, call +1 (743) 555-3824 or 555-123-4567. Ms. Anna Smith met Mr. John Smith; token = "24be64439e3e49cf" card 4111 1111 1111 1111 ip 8.8.4.4.'),
        (2, "john.Doe@Mail-3.example.co.uk Herr Müller, г-н Иванов, г-жа Анна Иванова, ssn 123-45-6789, +1 (743) 555-3824"),
        (3, "nothing here: 12 34, 3.14, a@b, v1.2.3"),
        (4, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(docs, "k1").collect()}
    for v in ("john.Doe", "743", "555-123-4567", "Anna", "Smith", "24be64439e3e49cf", "4111", "8.8.4.4", "Müller", "Иванов", "123-45-6789"):
        assert all(v not in (r.text or "") for r in got.values())
    assert got[3].text == rows[2][1] and got[4].text is None and got[3].n_entities == 0
    # one value, one surrogate
    mail = re.search(r"\S+@\S+\.uk", got[1].text)[0]
    assert mail.rstrip(",") in got[2].text and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text)[0] in got[2].text
    last = re.search(r"Ms\. \S+ (\S+) met Mr\. \S+ (\S+);", got[1].text)
    assert last[1] == last[2]
    assert re.search(r"г-н [А-Я][а-я]+, г-жа [А-Я][а-я]+ [А-Я][а-я]+,", got[2].text)
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", got[1].text)[1].replace(" ", "")
    assert sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(card)) % 10 == 0
    other = {r.doc_id: r.text for r in pii.pseudonymize(docs, "k2").collect()}
    assert other[1] != got[1].text and {r.doc_id: r.text for r in pii.pseudonymize(docs, "k1").collect()} == {d: r.text for d, r in got.items()}


def test_surrogates_stay_distinct(spark):
    """Values of a format with hardly more room than values: collisions are found and drawn anew."""
    values = spark.createDataFrame([("secret", f"A{i}") for i in range(0, 60)] + [("secret", f"B{i:02}") for i in range(40)], "type string, value string").distinct()
    got = pii.assign(values).collect()
    assert len({r.surrogate for r in got}) == len(got) == values.count()
    assert not {r.surrogate for r in got} & {r.value for r in got}


def test_surrogates_where_a_format_has_no_room(spark):
    """Every form of a format is a value: all get surrogates, wider ones. Masked secrets stay."""
    pins = [("secret", f"{c}{i}") for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for i in range(10)]
    got = {r.value: r.surrogate for r in pii.assign(spark.createDataFrame(pins, "type string, value string")).collect()}
    assert len(set(got.values())) == len(got) == 260
    assert all(re.fullmatch(r"[A-Z]\d{2,}", x) for x in got.values())
    texts = ['password = "******", token: "......"', 'password = "******" and token = "a1b2c3"']
    masked = sorted(tuple(r) for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert masked[0] == (0, texts[0], 0, []) and masked[1][2:] == (1, ["secret"])
    assert masked[1][1].startswith('password = "******" and token = "') and "a1b2c3" not in masked[1][1]


def test_whole_names_and_their_mentions(spark):
    rows = [
        (1, "Mr McDonald and Dr Jean-Luc Picard met Mr O'Brien. McDonald, Picard's and O'Brien stay; Picards, Lucas too."),
        (2, "Dr John Smith, Mr John Smith's and Smith; Smithson."),
        (3, "Smith is not known here."),
    ]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    w = r"(\w+)"
    one = re.fullmatch(rf"Mr {w} and Dr {w} {w} met Mr {w}\. {w}, {w}'s and {w} stay; Picards, Lucas too\.", got[1].text)
    assert one and one[1] == one[5] and one[3] == one[6] and one[4] == one[7] and not set(one.groups()) & {"McDonald", "Jean", "Luc", "Picard", "Brien"}
    two = re.fullmatch(rf"Dr {w} {w}, Mr {w} {w}'s and {w}; Smithson\.", got[2].text)
    assert two and two[1] == two[3] and two[2] == two[4] == two[5] and "John" not in two.groups() and "Smith" not in two.groups()
    assert got[3].text == rows[2][1] and (got[1].n_entities, got[2].n_entities) == (7, 5)


def test_long_secrets_and_genders_of_last_names(spark):
    rows = [(1, 'token = "' + "a1" * 400 + '"'), (2, "г-жа Анна Иванова, г-н Иванов, Mr. ANNA SMITH"), (3, "Dr. Anna Smith and Ms. Anna Smith")]
    got = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert re.fullmatch(r'token = "([a-f]\d){400}"', got[1]) and "a1a1a1" not in got[1]
    assert re.fullmatch(r"г-жа [А-Я][а-я]+ [А-Я][а-я]+(ва|на|ская), г-н [А-Я][а-я]+(в|н|ский), Mr\. [A-Z]+ [A-Z]+", got[2])
    names = re.fullmatch(r"Dr\. (\w+) (\w+) and Ms\. (\w+) (\w+)", got[3])
    assert names[1] == names[3] and names[2] == names[4]


def test_session_key(spark):
    """Without a key the session draws one, keeps it, and takes the one that is set."""
    before = spark.conf.get(pii.KEY_SETTING, None)
    spark.conf.unset(pii.KEY_SETTING)
    first = pii.session_key(spark)
    assert len(first) == 64 and pii.session_key(spark) == first
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == "mine"
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark) not in (first, "mine")
    if before:
        spark.conf.set(pii.KEY_SETTING, before)


def test_mac_is_hmac(spark):
    import hmac

    for key in ("k", "long " * 30):
        got = spark.createDataFrame([("é|x|0",)], "m string").select(pii._mac(key, F.col("m")).alias("h")).first().h
        assert got == hmac.new(key.encode(), "é|x|0".encode(), "sha256").hexdigest()


def test_no_plan_has_the_key(spark):
    """Neither the key nor its pads, as text, bytes or hex, in any form of the plan; and the setting's name is one that Spark hides."""
    key = "a very secret key"
    rows = pii.drawn(spark.createDataFrame([("email", "a@b.org", 0)], "type string, value string, attempt int"), key)
    run = rows._jdf.queryExecution()
    text = " ".join([run.toString(), run.logical().toString(), run.analyzed().treeString(), run.optimizedPlan().toJSON(), run.executedPlan().toString()]).lower()
    for secret in (key.encode(), *pii._pads(key)):
        assert secret.hex() not in text and secret.decode("latin-1").lower() not in text and str(list(secret))[1:-1] not in text
    assert rows.first().surrogate == spark.createDataFrame([("email", "a@b.org", 0)], "type string, value string, attempt int").select(pii.surrogate(*map(F.col, ("type", "value", "attempt")), key).alias("s")).first().s
    assert re.search("(?i)secret|password|token|access[.]?key", pii.KEY_SETTING)


def test_replaced_texts_against_a_plain_search(spark):
    """Every match of a plain search over all texts is replaced and nothing else; one surrogate a value, of its shape, distinct, and never a value itself."""
    regex = pytest.importorskip("regex")
    pattern, looks = regex.compile(pii.ANY), {k: regex.compile(p) for k, p in pii._LOOKS.items()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    shape = lambda v: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", v)))
    surrogates, found = {}, 0
    for r in pii.pseudonymize(docs, "k").collect():
        matches = list(pattern.finditer(texts[r.doc_id] or ""))
        kinds = [next((k for k, p in looks.items() if p.search(m[0])), "secret") for m in matches]
        assert r.n_entities == len(matches) and r.types == sorted(set(kinds))
        if not matches:
            assert r.text == texts[r.doc_id]
            continue
        found += len(matches)
        ends = [0, *(m.end() for m in matches)]
        gaps = [texts[r.doc_id][a:m.start()] for a, m in zip(ends, matches)] + [texts[r.doc_id][ends[-1] :]]
        parts = re.fullmatch("(.+?)".join(map(re.escape, gaps)), r.text, re.S)
        for kind, m, s in zip(kinds, matches, parts.groups(), strict=True):
            assert surrogates.setdefault((kind, m[0]), s) == s
            assert kind == "ip" or shape(s) == shape(m[0])
    assert found > 80
    for kind in {k for k, _ in surrogates}:
        of = {v: s for (k, v), s in surrogates.items() if k == kind}
        assert len(set(of.values())) == len(of) and not set(of.values()) & set(of)
