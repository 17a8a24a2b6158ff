"""Operators against brute force on small data, and their defined results for odd rows and empty tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import same_rows
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, language, licenses, lm, packing, pieces, quality, queries, sharding, simhash, suffix_dedup
from corpusloom.llm.common import doc_fold

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert same_rows(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) > 0


def stripped(text):
    return "".join(c for c in text or "" if c not in exact_dedup.SPACES)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.lit("one"), lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)])
def test_exact_groups(odd_docs, digest):
    """Also with digests that collide: whole texts decide."""
    got = rows(exact_dedup.exact_groups(odd_docs, digest=digest))
    given = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    groups = {}
    for i, t in given:
        groups.setdefault(stripped(t), []).append((-len(t), i is None, i or 0, i))
    want = Counter()
    for key, members in groups.items():
        keep = sorted(members)[0]
        for k, m in enumerate(sorted(members)):
            want[m[3], keep[3], len(members), k == 0, hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_exact_groups_of_extreme_ids_and_a_large_group(spark, monkeypatch):
    """The smallest long is an id like any other; a large group is met in parts, also where digests collide."""
    monkeypatch.setattr(exact_dedup, "MEET", 7)
    docs = spark.createDataFrame([(-(1 << 63), "a b"), ((1 << 63) - 1, "ab"), *((i, "a  b" if i % 2 else "c") for i in range(60))], "doc_id long, text string")
    for digest in (exact_dedup.sha256, lambda c: F.lit("one")):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows(exact_dedup.exact_groups(docs, digest=digest))}
        assert got[-(1 << 63)] == got[(1 << 63) - 1] == got[3] == (1, 32) and got[4] == (0, 30)


def test_exact_dedup(odd_docs, no_docs):
    kept = exact_dedup.exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(stripped(r.text) for r in kept.collect()) == sorted({stripped(r.text) for r in odd_docs.collect()})
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_state_over_batches(spark, odd_docs, tmp_path):
    """The state carries over from one micro-batch to the next."""
    path = str(tmp_path / "in")
    odd_docs.repartition(6).select("doc_id", F.length("text").alias("n_points"), F.coalesce("text", F.lit("")).alias("digest"), F.lit(1).cast("long").alias("copies")).write.parquet(path)
    schema = spark.read.parquet(path).schema
    one, many = (sorted(map(tuple, exact_dedup.run_state(spark, path, schema, n).collect()), key=str) for n in (None, 1))
    assert one == many


def simhash_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd_docs, no_docs):
    got = rows(simhash.near_duplicates(odd_docs))
    given = odd_docs.collect()
    assert len(got) == len(given)
    prints = [(r.doc_id, simhash_of(r.text)) for r in given]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{p:016x}") for i, p in prints)
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}
    for _ in values:
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, least.get(root[p])) for i, p in prints}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_trie_join_is_whole():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    values = [c ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 7)).tolist()))) for c in centres for _ in range(20)]
    values = np.unique(np.array(values, np.uint64))
    a, b = simhash.trie_links(np.zeros(len(values), np.int64), values, 4, chunk=64)
    label = np.arange(len(values))

    def spread(pairs):
        label = np.arange(len(values))
        for _ in range(len(values)):
            before = label.copy()
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
            if (label == before).all():
                return label
        return label

    near = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 4]
    assert all(int(values[i] ^ values[j]).bit_count() <= 4 for i, j in zip(a, b))
    assert (spread(list(zip(a, b))) == spread(near)).all()
    assert label is not None


def test_links_of_a_large_group_are_a_forest():
    """A group in which all are linked gives one link less than it has members, whatever its size."""
    rng = np.random.default_rng(4)
    for n in (40, 400):
        values = np.unique(np.uint64(5 << 40) ^ (np.uint64(1) << rng.integers(0, 32, (n, 2)).astype(np.uint64)).sum(1, dtype=np.uint64))
        a, b = simhash.trie_links(np.zeros(len(values), np.int64), values, 4)
        assert len(a) == len(values) - 1


def test_components_with_more_edges(spark):
    """As the components of all edges; of edges within a group nothing is left to contract."""
    rng = np.random.default_rng(6)
    one, two = ([(int(a), int(b)) for a, b in rng.integers(0, 120, (n, 2))] for n in (60, 30))
    one, two, both = (spark.createDataFrame(e, "a long, b long") for e in (one, two, one + two))
    roots = simhash.components(one)
    assert sorted(simhash.components_with(roots, two).collect()) == sorted(simhash.components(both).collect())
    assert sorted(simhash.components_with(roots, one).collect()) == sorted(roots.collect())


def test_near_dedup_contracts_each_group_once(spark, monkeypatch):
    """Edges that are contracted after the first similar pairs lie between groups, not within them."""
    rng = np.random.default_rng(9)
    texts = []
    for i in range(300):
        words = [f"w{k}" for k in range(150)]
        for at in rng.choice(150, 1 + i % 3, replace=False):
            words[at] = f"x{i}y{at}"
        texts.append((i, " ".join(words)))
    edges, contract = [], simhash.components

    def counted(e):
        edges.append(e.where("a <> b").distinct().count())
        return contract(e)

    monkeypatch.setattr(simhash, "components", counted)
    assert [r.doc_id for r in simhash.near_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()] == [0]
    assert len(edges) == 4 and sum(edges[1:]) < 300


def test_near_dedup_in_a_family_of_three(spark, monkeypatch):
    """A similar pair of three candidates is found where the pairs that span them hide it, also if it has the smallest node."""
    words = [f"w{k}" for k in range(400)]
    far = [f"x{k}" if k % 40 < 2 else w for k, w in enumerate(words)]
    texts = [" ".join(words), " ".join(words[:-1] + ["end"]), " ".join(far)]
    nodes = [int(np.int64(r.node)) for r in spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", simhash.wide_node(F.col("text"))[1].alias("node")).orderBy("doc_id").collect()]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    assert simhash.jaccard(sets[0], sets[1]) >= 0.8 > max(simhash.jaccard(sets[0], sets[2]), simhash.jaccard(sets[1], sets[2]))
    found, calls = simhash.wide_candidates, []

    def spanning(prints, *limit):
        calls.append(limit)
        if len(calls) > 1:
            return found(prints, *limit)
        pairs = [(max(n, nodes[2]), min(n, nodes[2])) for n in nodes[:2]]
        return spark.createDataFrame(pairs, "a long, b long")

    monkeypatch.setattr(simhash, "wide_candidates", spanning)
    assert {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()} == {0, 2}


def test_heavy_blocks_meet_in_parts(spark):
    """Groups above the limit are met part by part and lose no link."""
    values = [(5 << 40) ^ (1 << k) for k in range(40)]
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = simhash.components(simhash.links(prints, 4, heavy=7)).collect()
    assert {r.root for r in roots} == {min(values)} and len(roots) == len(values) - 1


def test_near_dedup(odd_docs, no_docs):
    kept = simhash.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and not {2, 3, 4} & set(ids)
    assert {100 + i for i in range(20)} <= set(ids) and simhash.near_dedup(no_docs).count() == 0


def test_near_dedup_in_a_family_of_less_similar_texts(spark):
    """Candidates that fail the comparison must not hide the similar pairs beside them."""
    rng = np.random.default_rng(5)

    def changed(words, n, tag):
        words = list(words)
        for k, at in enumerate(rng.choice(len(words), n, replace=False)):
            words[at] = f"{tag}x{k}"
        return words

    texts = {i: changed([f"w{k}" for k in range(400)], 6, f"f{i}") for i in range(120)}
    texts |= {1000 + i: changed(texts[i], 4, f"g{i}") for i in range(0, 120, 4)}
    texts = {i: " ".join(w) for i, w in texts.items()}
    sets = {i: np.unique(simhash.shingle_hashes(t, 5)) for i, t in texts.items()}
    wide = {i: np.frombuffer(simhash.wide_fingerprint(t, 5, 8), np.uint8) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            off = np.bitwise_count(wide[a] ^ wide[b]).reshape(16, 4)
            met = off.sum() <= simhash.LOOSE and (((off[:, 0] == 0) | (off[:, 2] == 0)) & (off.sum(1) <= 3)).any()
            if a < b and met and simhash.jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == set(root.values())


def test_maps_rule_no_similar_pair_out():
    """Whatever the size of the texts; and they rule most others out."""
    rng = np.random.default_rng(8)
    ruled = 0
    for n in (1, 3, 40, 300, 6000):
        for share in (0.5, 0.7, 0.79, 0.8, 0.81, 0.9, 1.0):
            pool = np.unique(rng.integers(0, 1 << 63, 3 * n).astype(np.uint64))
            both = int(round(2 * n * share / (1 + share)))
            a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:both], pool[n : 2 * n - both]])
            raw = np.stack([np.frombuffer(simhash.shingle_map(x), np.uint8) for x in (a, b)])
            size, maps = raw[:, :4].copy().view("<u4")[:, 0].astype(np.int64), raw[:, 4:].copy().view(np.uint64)
            may = simhash.may_be_similar(size, np.bitwise_count(maps).sum(1, dtype=np.int64), maps, np.array([0]), np.array([1]))[0]
            assert may or simhash.jaccard(a, b) < 0.8
            ruled += not may
    assert ruled >= 4


def test_wide_fingerprint_is_of_the_set():
    """A passage that repeats adds no shingle, so the fingerprint stays."""
    words = [f"w{k}" for k in range(500)]
    one, many = (" ".join(words[:100] + words[100:160] * n + words[100:104] + words[164:]) for n in (2, 9))
    assert set(simhash.shingle_hashes(one, 5)) == set(simhash.shingle_hashes(many, 5))
    assert simhash.wide_fingerprint(one, 5, 8) == simhash.wide_fingerprint(many, 5, 8)


def test_near_dedup_goes_by_row(spark):
    """A clean text stays, though its id is null, or stands on a near copy as well."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(200)) for c in "abc")
    given = [(1, one), (None, one + " more"), (None, two), (5, one + " end"), (5, three), (9, three + " end")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in simhash.near_dedup(docs).collect()}
    assert kept == {(1, one), (None, two), (5, three)}


def test_licenses(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(odd_docs))}
    assert (got[9]["n_words"], got[9]["n_base"], got[9]["base_labels"], got[9]["first_word"], got[9]["last_word"]) == (10, 3, "apache,gpl,mit", 1, 7)
    assert got[6]["n_words"] == 0 and got[6]["labels"] == "" and got[6]["first_word"] is None
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count() and licenses.scan_licenses(no_docs).count() == 0


def test_license_spans(spark):
    """A template with words added and left out is one span; a few words of it are none."""
    text = licenses.TEMPLATES[0][0].split()
    changed = " ".join([*"some words before".split(), *text[:20], "added", *text[20:30], *text[32:]])
    junk = ["the software " * 30, "and the software or the software " * 12, "the software " * 3000, " ".join(reversed(text))]
    after_junk = "the software " * 40 + " ".join(text)
    docs = spark.createDataFrame([(1, changed), (2, " ".join(text[:8])), (3, after_junk), *((10 + k, x) for k, x in enumerate(junk))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(docs))}
    assert all(got[10 + k]["labels"] == "" and got[10 + k]["score"] == 0 for k in range(len(junk)))
    assert (got[3]["labels"], got[3]["score"]) == ("mit-text", 1.0) and got[3]["spans"][0]["first"] == 80
    assert got[1]["labels"] == "mit-text" and got[1]["spans"][0]["first"] == 3 and len(got[1]["spans"]) == 1 and got[2]["labels"] == ""


def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_paths()[0])
    tokenizer.encode_special_tokens = True
    got = rows(packing.pack(odd_docs))
    want = Counter()
    for r in odd_docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        n, first = len(ids), len(ids) % 2048 or min(len(ids), 2048)
        for k, (a, b) in enumerate(zip([0, *range(first, n, 2048)], [*range(first, n, 2048), n])):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("text", ["a  b", "  x", "it's  we'll\n\n done ", "\x1c a  b", "tab\t x <|endoftext|>", "é" * 50 + " 12 345"])
def test_byte_bpe_like_the_tokenizer(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_paths()[0])
    tokenizer.encode_special_tokens = True
    assert np.frombuffer(packing.byte_bpe(packing.tokenizer_paths()[1]).encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


ADDED = ["end of one <|endoftext|> start", "<|endoftext|>", "<|endoftext|><|endoftext|> a", " a  <|endoftext|>\n b <|endoftext|>", "x<|endoftext|>y <|endoftext", "<|ENDOFTEXT|> <|endoftext|", "it's<|endoftext|>'s  é<|endoftext|>  \t"]


def test_packing_finds_the_added_token(spark):
    """By the tokenizer file as it is."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_paths()[0])
    assert tokenizer.encode(ADDED[0], add_special_tokens=False).ids.count(50256) == 1
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    want = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in enumerate(ADDED)}
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(docs).collect()}
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def test_plan_uses_few_sequences():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 5000)
    counts = np.bincount(lengths, minlength=101)
    made = packing.plan(counts, 100)
    assert made[:, 2].sum() == 5000
    assert (made[:, 3] + (made[:, 2] - 1) // made[:, 4]).max() + 1 <= 1.02 * -(-lengths.sum() // 100)


def test_pieces(odd_docs, no_docs):
    vocabulary = pieces.Pieces(pieces.vocabulary_path())

    def best(text):
        score, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - vocabulary.longest), end):
                found = vocabulary.score.get(text[begin:end]) or ((vocabulary.unknown, -1) if begin == end - 1 else None)
                if found and (score[end] is None or score[begin] + found[0] > score[end]):
                    score[end], back[end] = score[begin] + found[0], (begin, found[1])
        return vocabulary._path(text, back, 0, len(text))

    for r in pieces.encode_pieces(odd_docs, col="p").select("text", "p.*").collect():
        text = r.text or ""
        assert r.exact and r.n_ids == len(r.ids)
        if len(text) < 2000:
            assert list(r.ids) == (best(pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else [])
    long = "abcdefgh" * 400
    assert list(vocabulary.stream(long)) == best(long)
    back = pieces.decode_pieces(pieces.encode_pieces(odd_docs, col="p").select("text", "p.ids"))
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert pieces.encode_pieces(no_docs).count() == 0


def test_pieces_of_words_side_by_side():
    """Searching many words at once finds what the streaming search finds for each, odd characters and leading spaces included."""
    vocabulary = pieces.Pieces(pieces.vocabulary_path())
    rng = np.random.default_rng(4)
    letters = list("aeiourstnlk-'.,é😀ナ\x00\n\t▁")
    words = ["", "x" * 60, *("".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(3000))]
    assert vocabulary.search(words) == {w: vocabulary._word(w) for w in words}


def suffix_brute_force(given):
    first = {}
    given = [(i, i if i is not None else suffix_dedup.NO_ID, (t or "").encode()) for i, t in given]
    for _, i, raw in given:
        for a in range(len(raw) - 49):
            first[raw[a : a + 50]] = min(i, first.get(raw[a : a + 50], i))
    want = Counter()
    for doc_id, i, raw in given:
        gone = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - 49):
            if first[raw[a : a + 50]] < i:
                gone[a : a + 50] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[doc_id, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()] += 1
    return want


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup(odd_docs, no_docs, hot):
    want = suffix_brute_force((r.doc_id, r.text) for r in odd_docs.collect())
    assert Counter(tuple(r.values()) for r in rows(suffix_dedup.removal_report(odd_docs, hot))) == want
    assert suffix_dedup.removal_report(no_docs).count() == 0
    out = suffix_dedup.suffix_dedup(odd_docs, hot)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()


def test_suffix_dedup_of_one_string_in_thousands_of_contexts(spark):
    """Its windows are split, and those that repeat are found beside those that do not."""
    rng = np.random.default_rng(9)
    common = "a string that stands in all of them"
    texts = [f"{rng.integers(1 << 40):x} before {common} after {rng.integers(1 << 40):x} and {k % 700} more" for k in range(5000)]
    texts += [t[5:] for t in texts[:300]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = suffix_brute_force(enumerate(texts))
    assert Counter(tuple(r.values()) for r in rows(suffix_dedup.removal_report(docs, 1000))) == want
    kept = {r.doc_id: len(r.text) for r in suffix_dedup.suffix_dedup(docs, 1000).collect()}
    assert kept == {i: n - gone for i, n, gone, _, _ in want}


def test_merged_shards_give_intervals():
    """Merging many small shards gives the same intervals as comparing all strings."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 99, 70).astype(np.uint8)) for _ in range(12)]
    snips = [words[k] for k in rng.integers(0, 12, 40)]
    docs = rng.integers(0, 9, 40)
    first, count = suffix_dedup.first_documents(snips, docs, shard=150)
    least, want = {}, []
    for s, d in zip(snips, docs):
        for a in range(len(s) - 49):
            least[s[a : a + 50]] = min(d, least.get(s[a : a + 50], d))
    want = [least[s[a : a + 50]] for s in snips for a in range(len(s) - 49)]
    assert first.tolist() == want and count.sum() == len(want)


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(doc_fold(F.col("doc_id")) != 0))
    got = language.predict(docs.where(doc_fold(F.col("doc_id")) == 0), model).select("lang", "language.*").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)
    odd = {r.doc_id: r for r in language.predict(odd_docs, model, col="l").select("doc_id", "l.*").collect()}
    assert odd[6].lang_pred == odd[5].lang_pred == odd[12].lang_pred == "und" and all(0 <= r.score <= 1 for r in odd.values())
    assert language.train(no_docs) is None
    assert {r.language.lang_pred for r in language.predict(odd_docs.select("text"), None).collect()} == {"und"}
    runs = language.label_positions(odd_docs.where("doc_id = 8"), model).first().runs
    assert sum(r.length for r in runs) == len("kurz und gut")


def test_lm(odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", (doc_fold(F.col("doc_id")) == 1).alias("held_out"))
    got = rows(lm.score_texts(docs, docs.where("NOT held_out")))
    given = docs.collect()
    counts = Counter()
    for r in given:
        if not r.held_out:
            counts.update([*lm.tokens(r.text), None])
    total, types = sum(counts.values()), len(counts)
    want = []
    for r in given:
        own = [*lm.tokens(r.text), None]
        want.append((str(r.doc_id), len(own), sum(counts[t] > 0 for t in own), total, round(sum(np.log10((counts[t] + 0.5) / (total + 0.5 * (types + 1))) for t in own), 4)))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
    assert all(r["score"] < 0 for r in got)
    assert lm.score_texts(no_docs.select("doc_id", "text", F.lit(True).alias("held_out")), no_docs).count() == 0


def test_lm_score_by_hand(odd_docs, monkeypatch):
    """The score is that of the classes found, with counts gathered here again; few words are frequent, so all kinds take part."""
    monkeypatch.setattr(lm, "HEAD", 40)
    monkeypatch.setattr(lm, "WORDS", 10)
    docs = odd_docs.select("doc_id", "text", F.lit(False).alias("held_out"))
    given = [lm.tokens(r.text) for r in docs.collect()]
    counts = Counter(w for words in given for w in words)
    frame = lm.word_counts(docs)
    head, model = lm.fit(docs, frame, len(given))
    assert 0 < len(head.at) <= 40 and all(counts[w] >= max((n for x, n in counts.items() if x not in head.at and len(x) <= 64), default=0) for w in head.at)
    of = lambda w: int(model.of[-1] if w is None else model.of[head.at[w] if w in head.at else len(head.at) + lm.ending(w)])
    steps, size, types = Counter(), Counter({of(None): len(given)}), Counter({of(None): 1})
    for words in given:
        for a, b in zip([None, *words], [*words, None]):
            steps[of(a), of(b)] += 1
    for w, n in counts.items():
        size[of(w)] += n
        types[of(w)] += 1
    def score(words):
        total = 0.0
        for a, b in zip([None, *words], [*words, None]):
            row = sum(steps[of(a), c] for c in range(lm.CLASSES))
            own = len(given) if b is None else counts[b]
            total += np.log10((steps[of(a), of(b)] + 0.5) / (row + 0.5 * lm.CLASSES) * (own + 0.5) / (size[of(b)] + 0.5 * (types[of(b)] + 1)))
        return total

    want = sorted(round(score(words), 3) for words in given)
    assert np.allclose(sorted(r["score"] for r in rows(lm.score_texts(docs, docs))), want, atol=2e-3)


def test_sweeps_raise_likelihood(spark):
    """Words of two kinds that take turns end in classes of their own kind, though a quarter of them starts with the other."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'ab'[k % 2]}{rng.integers(60)}" for k in range(200)) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = lm.word_counts(docs)
    top = lm.frequent(counts)
    head = spark.sparkContext.broadcast(lm.Head([bytes(r["word"]) for r in top], [r["n"] for r in top]))
    units = lm.encoded(docs, head)
    kind = np.array([w.startswith(b"b") for w in head.value.at]).astype(np.int64)
    of = np.r_[kind ^ (rng.random(len(top)) < 0.25), np.zeros(lm.ENDINGS, np.int64), lm.CLASSES - 1]
    found, table = lm.swept(units, of, len(top), 6)
    assert table.sum() == 40 * 201 and lm.likelihood(table) > lm.likelihood(lm.swept(units, of, len(top), 0)[1])
    kinds = {}
    for w, i in head.value.at.items():
        kinds.setdefault(int(found[i]), set()).add(w[:1])
    assert sum(len(x) == 1 for x in kinds.values()) >= 0.9 * len(kinds)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    table = rng.poisson(np.kron(rng.random((4, 4)) * 8, np.ones((6, 6)))).astype(float)
    table = np.pad(table, (0, 1), constant_values=1)

    def gain(of):
        one = np.eye(of.max() + 1)[of]
        c = one.T @ table @ one
        return sum((x * np.log(np.maximum(x, 1))).sum() * s for x, s in ((c, 1), (c.sum(0), -1), (c.sum(1), -1)))

    assert gain(lm.exchange(table, 5)) > gain(np.r_[np.arange(24) % 4, 4])


def base_counts(text):
    words = (text or "").encode().split()
    times = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(odd_docs, no_docs):
    got = rows(quality.quality_report(odd_docs, "verdict").select("text", "verdict.*"))
    for r in got:
        want = base_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality.quality_filter(odd_docs).columns == odd_docs.columns
    assert quality.quality_report(no_docs).count() == 0


def test_quality_keeps_clean_texts(spark):
    """Against the labels: no clean text is rejected by the histograms, and most of the poor ones are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.quality_report(docs, "q").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").where("NOT q.base_failed")
    clean = got.where("label = 1")
    assert clean.where("NOT q.kept").count() == 0
    assert got.where("label = 0 AND NOT q.kept").count() > 0


def test_js_distance():
    p = np.array([0.5, 0.5, 0.0])
    assert np.allclose(quality.js_distance(p, np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])), [0, 1])


def test_sharding(odd_docs, no_docs):
    got = sharding.assign_shards(odd_docs)
    assert got.count() == odd_docs.count() and got.where("slot IS NULL OR shard IS NULL").count() == 0
    assert sharding.assign_shards(no_docs).count() == 0
    table = sharding.lookup_table(sharding.shard_names(16), 2039)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(sharding.shard_names(16)[:-1], 2039)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 15)
    assert moved < 0.1 * 2039
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_write_shards(odd_docs, tmp_path, spark):
    sharding.write_shards(odd_docs.drop("shard"), str(tmp_path / "s"), names=sharding.shard_names(4), size=101)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd_docs.count()
