"""Operators on texts against brute force, on hard rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from domicilia.llm.mixing import TARGETS, Mixing, rake
from domicilia.llm.near_dedup import NearDedup
from domicilia.llm.packing import Packing, best_fit, plan_ranges
from domicilia.llm.quality import QualityClassifier, estimate_prior
from domicilia.llm.secrets import SecretScan, redact, scan
from domicilia.llm.substring_dedup import SubstringDedup
from domicilia.llm.token_count import TokenCount
from domicilia.llm.words import Words

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _by(rows, key=lambda r: -1 if r.doc_id is None else r.doc_id):
    return sorted(rows, key=key)


def test_near_duplicates(docs, texts):
    sets = {}
    for i, text in texts:
        words = WORD.findall(_lower(text))
        sets.setdefault(i, set()).update({tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set())
    ids = sorted(i for i in sets if i is not None)
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = NearDedup().run(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == label.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == label[r.doc_id])


def test_packing(docs, texts, library):
    numbered = docs.filter("doc_id IS NULL OR doc_id != 12")
    got = Packing(PATH).run(numbered).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in texts:
        if i == 12:
            continue
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 0], 0
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert n == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000])
def test_packing_of_very_long_white_space(spark, library, run):
    text = f"x{run}y"
    got = Packing(PATH).run(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")).collect()
    ids = [*library.encode(text, add_special_tokens=False).ids, 0]
    pieces = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.piece)
    assert sum(r.length for r in pieces) == len(ids) and len(got) == len(pieces) + 1
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_length_once(seed):
    counts = np.random.default_rng(seed).integers(0, 6, 65)
    counts[0] = 0
    rows, n = plan_ranges(counts, 64)
    total = int((counts * np.arange(65)).sum())
    alone = sum(k for k, _ in best_fit(counts.astype(np.int64).copy(), 64))
    assert -(-total // 64) <= n <= alone + 1
    for length in range(1, 65):
        assert len(rows[rows[:, 0] == length]) or not counts[length]


def test_secrets(docs, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for i, text in texts:
        kinds = [
            [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12],
            [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
            [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16],
        ]
        spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(sum(kinds, [])))
        want.append((i, *map(len, kinds), hashlib.sha256(spans.encode()).hexdigest()))
    got = SecretScan().run(docs).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == order(want)


def test_weak_candidates_need_their_complement():
    assert scan("token: abcd", 200) == ([], [])
    together = "token: abcd user=someone https://host.example/x"
    assert {kind for _, _, kind in scan(together, 200)[1]} == {"short", "account", "endpoint"}
    assert scan("token: abcd" + " " * 500 + "user=someone https://host.example/x", 200)[1] == []
    assert "abcd" not in redact(together, 200)


def test_taken_spans():
    from domicilia.llm.secrets import _Taken

    random = np.random.default_rng(8)
    spans = [(int(a), int(a + n)) for a, n in zip(random.integers(0, 300, 40), random.integers(1, 30, 40), strict=True)]
    taken = _Taken(spans)
    for low in range(0, 330, 3):
        for high in (low + 1, low + 9):
            assert taken.meets(low, high) == any(a < high and b > low for a, b in spans)
    assert not _Taken([]).meets(0, 9)


def test_substrings(docs, texts):
    rows = sorted((i, t) for i, t in texts if i is not None and i != 12)
    seen, want = set(), {}
    for i, text in rows:
        words = WORD.findall(text)
        cover = np.zeros(len(words), bool)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                cover[k : k + 20] = True
            seen.add(window)
        kept = " ".join(w for w, c in zip(words, cover, strict=True) if not c)
        want[i] = (len(words), int(cover.sum()), hashlib.sha256(kept.encode()).hexdigest())
    got = SubstringDedup().run(docs.filter("doc_id IS NOT NULL AND doc_id != 12"), with_text=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_token_counts(docs, texts, library):
    want = sorted((str(i), len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    got = TokenCount(PATH).run(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_raking_meets_margins():
    table = np.random.default_rng(0).integers(1, 50, (4, 3, 5)).astype(float)
    targets = [np.array([1.0, 2, 3]), np.array([1.0, 1]), np.array([4.0, 3, 2, 1])]
    fitted = table * rake(table, targets)
    for axis, target in enumerate(targets):
        margin = fitted.sum(tuple(a for a in range(3) if a != axis)) / fitted.sum()
        rest = table.sum(tuple(a for a in range(3) if a != axis))[-1] / table.sum()
        assert np.allclose(margin, [*target / target.sum() * (1 - rest), rest])


def test_mixing_rows(docs, no_docs, texts):
    got = Mixing(TARGETS).run(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in texts)
    assert sum(r.n_tokens for r in got) == sum(len(WORD.findall(t)) for _, t in texts)
    for r in got:
        digits = hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12]
        assert r.u == int(digits, 16) / (1 << 48) and r.sampled == (r.u < r.probability)
    assert Mixing(TARGETS).run(no_docs).count() == 0


def test_quality_on_held_out_texts(spark):
    from domicilia.llm.tables import read

    rows = QualityClassifier().run(read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels"))
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    found = rows.join(labels, "doc_id").filter("held_out").toPandas()
    assert (found.predicted == found.quality).mean() >= 0.95
    assert rows.selectExpr("every(score BETWEEN 0 AND 1 AND held_out = (crc32(cast(doc_id AS string)) % 4 = 2))").first()[0]


def test_quality_of_hard_rows(spark, docs, no_docs, texts):
    none = spark.createDataFrame([(None, 1, None), (1, None, 0)], "doc_id long, quality int, text string")
    got = QualityClassifier().run(docs, none).collect()
    assert len(got) == len(texts) and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(1, 1), (6, 1), (8, 1), (8, 1), (10, 0)], "doc_id long, quality int")
    assert QualityClassifier().run(docs, some).count() == len(texts)
    assert QualityClassifier().run(no_docs, some).count() == 0


def test_quality_learns_from_every_picked_id(spark, monkeypatch):
    from domicilia.llm import quality

    taken = []
    monkeypatch.setattr(quality, "fit", lambda pos, unl: taken.append((len(pos), len(unl))))
    model = QualityClassifier(sample=3, held=-1)
    rows = [(1, f"text {k}") for k in range(40)] + [(2, "good text"), (3, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model.model(docs, spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, quality int"))
    assert taken == [(2, 3)]


def test_quality_fits_all_texts(spark, monkeypatch):
    """More texts than a sample would hold; every one is in the sums."""
    from domicilia.llm import quality

    seen = []
    real = quality._added

    def watched(rows, block, size):
        seen.append(rows.agg(F.sum(F.col("good").cast("int")), F.count("*")).first())
        return real(rows, block, size)

    monkeypatch.setattr(quality, "_added", watched)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, '###### ! 99', concat('plain words of text ', id % 50)) AS text")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 0, 1) AS quality").filter("doc_id % 2 = 0")
    classifier = QualityClassifier(held=-1, shard=8000, least=3000)
    model = classifier.model(docs, labels)
    assert {tuple(s) for s in seen} == {(6666, 20_000)}
    assert model.prior == pytest.approx(2 / 3, abs=0.03)
    scored = classifier.scored(docs, model).groupBy((F.col("doc_id") % 3 == 0).alias("junk")).agg(F.min("score"), F.max("score"))
    found = {r.junk: r for r in scored.collect()}
    assert found[True][2] < 0.3 and found[False][1] > 0.7


def test_prior():
    random = np.random.default_rng(1)
    pos, neg = random.normal(2, 1, 4000), random.normal(-3, 1, 4000)
    assert abs(estimate_prior(pos[:2000], np.concatenate([pos[2000:], neg[:500]])) - 0.8) < 0.05


@pytest.mark.parametrize("run", [
    NearDedup().run, Packing(PATH).run, SecretScan().run, TokenCount(PATH).run,
    lambda d: SubstringDedup().run(d, with_text=False),
])
def test_empty_table(run, no_docs):
    assert run(no_docs).count() == 0


def _unlike_words(n):
    """Two words of n letters that polynomials of wrapping numbers cannot tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_are_told_apart(spark):
    """Different words of one length and letter count have different hashes, so they link and repeat nothing."""
    one, other = _unlike_words(1024)
    words = Words.of(pa.array([f"{one} {other} {one}"]))
    for fold in (False, True):
        for seed in (0, 1):
            a, b, again = words.hashes(fold, seed).tolist()
            assert a == again != b
    rows = [(1, " ".join([one] * 20)), (2, " ".join([other] * 20)), (3, " ".join([one] * 20))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in NearDedup().run(frame).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_removed for r in SubstringDedup().run(frame).collect()} == {1: 0, 2: 0, 3: 20}


def test_hashes_of_many_words():
    """No two of many short and long words agree in either hash; case folds only where asked."""
    words = [f"w{k}" for k in range(20000)] + ["x" * k for k in range(1, 400)] + ["x" * 64 + c for c in "abc"] + ["Äb", "äb", "AB", "ab"]
    cut = Words.of(pa.array([" ".join(words)]))
    for seed in (0, 1):
        assert len(set(cut.hashes(seed=seed).tolist())) == len(words)
    folded = cut.hashes(fold=True).tolist()
    assert folded[-1] == folded[-2] and folded[-3] != folded[-4]


def test_a_line_that_all_texts_share_meets_in_no_bucket(spark):
    """Its runs come last, so the windows around it go where their other words send them; results are the same."""
    from domicilia.llm import substring_dedup as sd

    rng = np.random.default_rng(9)
    line = " ".join(f"shared{k}" for k in range(10))
    texts = []
    for _ in range(300):
        words = [f"w{k}" for k in rng.integers(0, 1 << 40, 80)]
        texts.append(" ".join([*words[:40], line, *words[40:]]))
    texts += [texts[5], texts[7] + " more"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain, ordered = SubstringDedup(sample=0), SubstringDedup()
    assert len(plain.frequent_runs(frame)) == 0 and len(ordered.frequent_runs(frame)) == 7
    got = [sorted(map(tuple, op.run(frame, with_text=False).collect())) for op in (plain, ordered)]
    assert got[0] == got[1] and sum(r[2] for r in got[0]) == 180
    words = Words.of(pa.array(texts[:300]))
    largest = []
    for op in (plain, ordered):
        kmers = sd.SuperKmers.cut(words, words.hashes(), 20, 4, op.frequent_runs(frame))
        largest.append(np.unique(kmers.seed, return_counts=True)[1].max())
    assert largest[0] > 100 and largest[1] <= 2


def test_minimisers_are_those_of_all_windows():
    """Each window is in one super-k-mer, whose seed is the least of the window's runs in the order given."""
    from domicilia.llm import substring_dedup as sd
    from domicilia.llm.words import mix

    words = Words.of(pa.array([" ".join(f"v{k * k % 37}" for k in range(90)), "few words", " ".join(f"v{k}" for k in range(30))]))
    hashes = words.hashes()
    runs = words.runs(hashes, 4)
    frequent = np.sort(runs[10:30])
    kmers = sd.SuperKmers.cut(words, hashes, 20, 4, frequent)
    ranks = mix(runs ^ sd._OTHER) >> np.uint64(1)
    ranks = np.where(np.isin(runs, frequent), ranks | np.uint64(1 << 63), ranks)
    seen = []
    for low, high, seed in zip(kmers.low, kmers.high, kmers.seed, strict=True):
        for start in range(low, high):
            seen.append(start)
            assert ranks[start : start + 17].min() == seed
    assert sorted(seen) == [*range(71), *range(92, 103)]


def test_vocabularies_numbered_otherwise_are_refused(tmp_path):
    """Ranks are taken from ids, so these must follow the merges."""
    import json

    from domicilia.llm.tokens import vocabulary

    with open(PATH, encoding="utf-8") as f:
        described = json.load(f)
    merges = described["model"]["merges"]
    merges[3], merges[4] = merges[4], merges[3]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(described), encoding="utf-8")
    with pytest.raises(ValueError, match="order of its merges"):
        vocabulary(str(other))
