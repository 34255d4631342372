"""Token counts, BPE, token files and packing, against the tokenizer libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

from paperloom.llm import bytepair, packing, pieces, tokenfile, tokens, wordids

JSON, RANKS, PIECES = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
MIXED = st.text(st.sampled_from(list("abeéthin \n▁日語<s>0x\t  .,'😀²½\x1c\x85")), max_size=60)
EDGE = ["", " ", "a", "it's we'll  \n\n x", "é" * 70, "a" * 5000, "<|endoftext|>", "日本語 テキスト", "0x41 <0x41> <s> ▁", "\x1c\x85 ª²½"]


@pytest.fixture(scope="module")
def unigram():
    t = Tokenizer(models.Unigram(tokens.vocabulary(PIECES), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hub():
    return Tokenizer.from_file(JSON)


@settings(max_examples=300, deadline=None)
@given(text=MIXED)
def test_unigram_counts(unigram, text):
    assert tokens.load(PIECES).count(text) == len(unigram.encode(text, add_special_tokens=False).ids)


def test_unigram_ties_and_runs_of_unknowns():
    pieces_ = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("bb", -3.0)]
    t = Tokenizer(models.Unigram(pieces_, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = tokens.UnigramCounter(pieces_)
    for text in ("ab", "abab", "bbb", "xx", "axxb x", "x\nx", "aabb xyab"):
        assert c.count(text) == len(t.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=300, deadline=None)
@given(text=MIXED)
def test_bpe_is_tiktokens(tik, text):
    bpe = bytepair.load(RANKS, P.PATTERN)
    ids = bpe.encode(text)
    assert ids == tik.encode_ordinary(text) and bpe.decode(ids) == text.encode()


def test_bpe_joins_every_match(tik):
    """A text's ids come out of joins of halves: a match of n bytes takes n - 1, less those of subtrees that are kept."""
    bpe = bytepair.ByteBPE.from_file(RANKS, P.PATTERN)
    text = "Unbelievable antidisestablishmentarianism, 12345 naïve façades"
    words = bpe.find(text)
    seen: dict[bytes, int] = {}
    join = bpe.join
    bpe.join = lambda a, b: seen.update({b"".join(map(bpe.bytes_of.get, a + b)): 1}) or join(a, b)
    assert bpe.encode(text) == tik.encode_ordinary(text)
    assert all(len(w.encode()) == 1 or w.encode() in seen for w in words)
    fresh = bytepair.ByteBPE.from_file(RANKS, P.PATTERN)
    long = "qzxv" * 50_000  # one match
    assert fresh.encode(long) == tik.encode_ordinary(long) and fresh.joins > len(long) // bytepair.SUBTREE - 1
    fresh.nodes.clear()
    assert fresh.decode(fresh.encode(text)) == text.encode()


@pytest.mark.parametrize("alphabet", ["a", "ab", "the an", "=-_", "\n \t"])
def test_bpe_of_long_pieces(tik, alphabet):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list(alphabet), 20_000))
    assert bytepair.load(RANKS, P.PATTERN).encode(text) == tik.encode_ordinary(text)


def test_join_grows_its_window(tik):
    bpe = bytepair.load(RANKS, P.PATTERN)
    for text in ("indivisibility", "aaaaaaaaaaaaaaaaaaaaaaaaa", "antidisestablishmentarianism" * 3):
        for cut in range(1, len(text)):
            assert bpe.join(bpe.merge(text[:cut].encode()), bpe.merge(text[cut:].encode())) == bpe.merge(text.encode())


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.characters(max_codepoint=255), max_size=40))
def test_narrow_pattern(text):
    assert pieces.finder(P.PATTERN)(text) == regex.findall(P.PATTERN, text)
    assert pieces._narrow(r"\w+|x") is None


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(MIXED, st.lists(st.sampled_from([" the", " and", "x", " ñab", "<|endoftext|>"]), max_size=20).map("".join)))
def test_word_ids(hub, text):
    assert np.frombuffer(wordids.load(JSON, P.PATTERN)(text), np.uint32).tolist() == hub.encode(text, add_special_tokens=False).ids


def test_spelled_out_tokens(hub, tmp_path):
    """A token's literal is its one id, wherever it stands, also in texts that are cut into segments."""
    ids = lambda t, path=JSON: np.frombuffer(wordids.load(path, P.PATTERN)(t), np.uint32).tolist()
    assert [t.content for t in hub.get_added_tokens_decoder().values()] == ["<|endoftext|>"]
    assert ids("x <|endoftext|> y") == [87, 220, 50256, 331]
    end = "<|endoftext|>"
    texts = [*EDGE, f"{end}{end} \n{end}", f"a{end}b", f"it{end}'s  {end}  x", "x <|endoftext| > y", "<|ENDOFTEXT|>", f"<|endof{end}text|>", f"<|endoftext{end}"]
    texts.append((f" word  {end}\n" + "abc " * 50_000) * 8)
    for text in texts:
        assert ids(text) == hub.encode(text, add_special_tokens=False).ids, text[:80]
    more = Tokenizer.from_file(JSON)
    more.add_special_tokens([AddedToken("<|end", special=True), AddedToken("<w>", single_word=True, special=True), AddedToken("<l>", lstrip=True, special=True)])
    more.save(str(tmp_path / "more.json"))
    for text in (f"a <|end b {end}", "a<w>b <w> c", f"x  <l> y{end}", "<|end<|end"):
        assert ids(text, str(tmp_path / "more.json")) == more.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 200_001, dtype=np.uint64).astype(np.uint32)
    assert (tokenfile.unpack(tokenfile.pack(ids, bits), len(ids), bits) == ids).all()
    assert len(tokenfile.pack(ids, bits)) == (len(ids) * bits + 7) // 8
    with open(tmp_path / "f", "wb") as out:
        w = tokenfile.Writer(out, bits)
        for i, part in enumerate(np.split(ids, [0, 5, 70_000, 140_000])):
            w.add(i if i else None, part)
        w.close()
    with open(tmp_path / "f", "rb") as f:
        r = tokenfile.Reader(f)
        assert (r.slice(65_530, 131_080) == ids[65_530:131_080]).all() and r.null.tolist() == [True, False, False, False, False]
        assert (r.document(3) == ids[70_000:140_000]).all() and len(r.document(0)) == 0


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edge_tables(documents, unigram, tik, hub):
    given_ = [(3, None), (None, "null id"), (7, "twice"), (7, "twice"), *[(20 + i, t) for i, t in enumerate(EDGE)]]
    docs = documents(given_)
    whole = [(i, t or "") for i, t in given_]
    assert rows(tokens.token_counts(docs, PIECES)) == sorted(((i, len(unigram.encode(t, add_special_tokens=False).ids)) for i, t in whole), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x := tik.encode_ordinary(t)), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for i, t in whole]
    assert rows(bytepair.digests(docs, RANKS, P.PATTERN)) == sorted(want, key=repr)
    ids = bytepair.encoded(docs, RANKS, P.PATTERN)
    assert rows(bytepair.decoded(ids, RANKS, P.PATTERN)) == sorted(((i, bytearray(t.encode())) for i, t in whole), key=repr)
    got = [tuple(r) for r in tokenfile.token_files(docs, JSON, P.PATTERN).orderBy("start").collect()]
    at, order = 0, [i for i, _ in sorted(whole, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [g[0] for g in got] == order
    texts = dict(whole)
    for doc_id, start, n, crc, bits in got:
        x = np.array([*hub.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (start, n, crc, bits) == (at, len(x), zlib.crc32(x.tobytes()), 16)
        at += n
    empty = docs.limit(0)
    for out in (tokens.token_counts(empty, PIECES), bytepair.digests(empty, RANKS, P.PATTERN), tokenfile.token_files(empty, JSON, P.PATTERN), packing.packed(empty, JSON, P.PATTERN)):
        assert out.count() == 0


def test_files_of_several_ranges(documents, hub):
    docs = documents([(i * 7 % 100, f"text {i}" * i) for i in range(100)]).repartition(5)
    files = tokenfile.write_ids(docs, JSON, P.PATTERN, 2, tokenfile.new_path(docs.sparkSession, "ids"), file_docs=15)
    got = tokenfile.read_digests(docs.sparkSession, files).orderBy("start").collect()
    assert files.count() > 3 and [r.doc_id for r in got] == list(range(100))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_order_of_equal_ids(documents):
    """Documents of one doc_id or of none lie in the same order however they are dealt, in several files."""
    texts = [(7 if i % 3 else None, f"text {i % 40}") for i in range(150)]
    docs, seen = documents(texts), []
    for parts in (1, 6):
        files = tokenfile.write_ids(docs.repartition(parts), JSON, P.PATTERN, 2, tokenfile.new_path(docs.sparkSession, "ids"), file_docs=20)
        assert files.count() > 4
        seen.append([tuple(r) for r in tokenfile.read_digests(docs.sparkSession, files).orderBy("start").collect()])
    assert seen[0] == seen[1] and len(seen[0]) == 150 and [r[0] for r in seen[0]] == [None] * 50 + [7] * 100


def test_starts_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILES_A_BLOCK", 4)
    counts = [(p, p * 3 % 7) for p in range(30) if p % 5]
    got = {r.path: r.before for r in tokenfile.with_starts(spark.createDataFrame(counts, "part int, n long"), "/a%b").collect()}
    assert got == {f"/a%b/ids-{p:06d}.bin": sum(n for q, n in counts if q < p) for p, _ in counts}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bound_holds(lengths):
    """The bound is at most what best fit needs, and at least the sum over the size."""
    x = np.array(sorted(lengths, reverse=True), np.int64)
    bins, place, fill = packing.best_fit(x, 64)
    assert packing.lower_bound(x, 64) <= len(fill) and packing.lower_bound(x, 64) >= -(-int(x.sum()) // 64)
    assert (fill <= 64).all() and int(fill.sum()) == int(x.sum())


def test_bound_is_sharp():
    assert packing.lower_bound(np.array([33] * 10), 64) == 10
    assert packing.lower_bound(np.array([33, 33, 31, 31]), 64) == 2
    assert packing.lower_bound(np.array([22] * 9), 64) == 5  # two to a sequence


def test_repacking_closes_gaps():
    rng = np.random.default_rng(2)
    gaps = []
    for _ in range(20):
        x = np.sort(rng.integers(150, 400, 130))[::-1]
        _, _, fill = packing.best_fit(x, 2048)
        bins, used, bound = packing.fewest(x, 2048)
        place, filled = packing.places(x, bins)
        assert filled.max() <= 2048 and len(filled) == used <= len(fill) and filled.sum() == x.sum()
        for b in range(len(filled)):
            spans = sorted(zip(place[bins == b], x[bins == b]))
            assert [p for p, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist()
        gaps.append((len(fill) - bound, len(filled) - bound))
    assert sum(b for _, b in gaps) <= sum(a for a, _ in gaps)


@pytest.mark.parametrize(("lo", "hi", "most"), [(560, 800, 7236), (640, 725, 6700), (450, 600, 5400)])
def test_hard_mixes(lo, hi, most):
    """Thirds and quarters, of which best fit decreasing alone needs 7440, 7447 and 5755."""
    x = np.sort(np.random.default_rng(1).integers(lo, hi, 20_000))[::-1]
    bins, used, bound = packing.fewest(x, 2048)
    assert bound <= used <= most and np.bincount(bins, x).max() <= 2048 and len(np.unique(bins)) == used


def _optimum(lengths: list[int], size: int) -> int:
    """Every way to put pieces in bins, one piece after the other."""
    best = len(lengths)

    def put(i: int, fills: list[int]) -> None:
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for k in {f: k for k, f in enumerate(fills)}.values():
            if fills[k] + lengths[i] <= size:
                put(i + 1, [*fills[:k], fills[k] + lengths[i], *fills[k + 1 :]])
        put(i + 1, [*fills, lengths[i]])

    put(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(5, 40), min_size=1, max_size=12))
def test_small_groups_are_optimal(lengths):
    x = np.array(sorted(lengths, reverse=True), np.int64)
    bins, used, bound = packing.fewest(x, 64)
    assert np.bincount(bins, x).max() <= 64
    assert bound <= used == len(np.unique(bins)) == _optimum(x.tolist(), 64)
    assert len(np.unique(packing.exact(x, 64))) == used


def test_groups_exchange(spark):
    """Groups with gaps reach what one group reaches, and say which sequences are certified."""
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(560, 800, 900), rng.integers(20, 200, 300)])
    table = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], packing.PIECE)
    got = packing.pack(table, 2048, group_pieces=200).toPandas()
    fill = got.groupby("sequence_id").length.sum()
    assert len(got) == len(lengths) and fill.max() <= 2048 and (got.used >= got.bound).all()
    assert len(fill) <= packing.lower_bound(lengths, 2048) + 2 and packing.bound_of(table, 2048) == packing.lower_bound(lengths, 2048)


def test_packing(documents, spark, hub):
    texts = [(i, "word " * (i * 37 % 3000)) for i in range(120)] + [(500, None), (500, ""), (None, "x")]
    docs = documents(texts)
    cut = packing.pieces(docs, JSON, P.PATTERN, 0, 2048)
    got = packing.pack(cut, 2048, group_pieces=16).collect()
    assert len(got) == cut.count()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 2048) + 2
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts[:120]:
        ids = np.array([*hub.encode(text, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // 2048)
        assert all(p.length == 2048 for p in parts[1:])
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def test_equal_pieces_are_spread(spark, tmp_path):
    """Rows that repeat each other in all columns don't meet in a few groups."""
    one = "7L doc_id, 0 piece, 0L start, 900 length, 5L ids_crc32"
    spark.range(0, 20_000, 1, 4).selectExpr(*one.split(", ")).write.parquet(str(tmp_path / "p"))
    sizes = [r["count"] for r in packing.dealt(spark.read.parquet(str(tmp_path / "p")), 3, 20).groupBy("grp").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1300
