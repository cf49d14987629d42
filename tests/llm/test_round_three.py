"""Operators 11 to 13 against plain versions."""

import hashlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from turnwise.llm import divergence, pii, tokenalign, treebpe
from turnwise.session import table

ODD = [
    "", " ", "a", "Hello  World", "  lead", "trail  ", "x\n  y  z ", "\t tab\r\n", "don't 'S 'LL 12,5", "ΑΣ ΑΣΑ ΟΔΟΣ", "İstanbul ŸÀ", "é é ﬁ ½", "a\x1cb c\x85d", "a▁ b",
    "中文字 中文", "😀😀 😀", "<|endoftext|>Mid<|startoftext|> end<|endoftext|>", "<s> </s> <unk>", "　x y", "a" * 700 + " b", "ab" * 400, "\x00 z", "՘ ࢏ \U0001df25 new letters ꟋA",
    "z" * 3000, "the the the. The", "1234567 ①②",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "own", "x", "y") for i, t in enumerate(ODD)] + [(None, "no id", "", None, None), (3, "Hello  World", "", "x", "y"), (3, ODD[3], "", "x", "y"), (99, None, "", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, chunk string, decoded string").repartition(3)


def _word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(treebpe.default_path())


def test_tree_bpe_is_the_library(spark, odd, sf):
    library, path = _word_library(), treebpe.default_path()
    for docs in (odd, table(spark, sf, "documents")):
        texts = sorted([r.text or "" for r in docs.collect()])
        coded = treebpe.encode(docs, path=path)
        out = treebpe.decode(coded, path=path).collect()
        found = sorted((tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in out)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert found == sorted((tuple(w), library.decode(w, skip_special_tokens=False)) for w in want)


def test_tree_bpe_digest_and_odd_tables(spark, odd):
    library = _word_library()
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in treebpe.digest(odd).collect()}
    want = set()
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.add((r.doc_id, len(ids), *sha))
    assert rows == want and treebpe.digest(odd).count() == odd.count()
    assert treebpe.digest(odd.where("false")).count() == 0
    assert treebpe.decode(odd.select("doc_id", "decoded", treebpe.F.lit(None).cast("binary").alias("ids")), path=treebpe.default_path()).columns[-1] == "decoded_1"


def test_trees_of_both_kinds_merge_alike():
    """Random words over few letters; plain merging by scanning all pairs."""
    m, rng = treebpe.model(treebpe.default_path()), np.random.default_rng(7)
    words = ["".join(rng.choice(list("thersionaé"), n)) for n in [*range(1, 90), *rng.integers(1, 200, 150)]]

    def plain(word):
        raw = list(word.encode())
        sym = [*m.inner[raw[:-1]].tolist(), int(m.last[raw[-1]])]
        while True:
            ranks = [(m.pairs.get(a * m.size + b, 1 << 60), i) for i, (a, b) in enumerate(zip(sym, sym[1:]))]
            if not ranks or min(ranks)[0] == 1 << 60:
                return sym
            rank, i = min(ranks)
            sym[i : i + 2] = [int(m.merged[rank])]

    found = [np.frombuffer(x, "<u4").tolist() for x in treebpe.merge_words(m, words)]
    assert found == [plain(w) for w in words]
    long = [w.encode() for w in words if len(w.encode()) > 1]
    assert [np.frombuffer(treebpe._tree(m, [*m.inner[list(r[:-1])].tolist(), int(m.last[r[-1]])]), "<u4").tolist() for r in long] == [plain(r.decode()) for r in long]


def test_newer_letters_are_read_as_the_library_reads_them():
    library, m = _word_library(), treebpe.model(treebpe.default_path())
    texts = [f"a{chr(c)}b 'S{chr(c)} {chr(c)}{chr(c)}́" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in treebpe.encode_texts(m, texts)] == want


def test_long_texts_are_read_in_blocks(monkeypatch):
    library, m = _word_library(), treebpe.model(treebpe.default_path())
    text = ("Das ist éin Text, ́x ́y " * 50 + "w" * 99 + "\n") * 3
    monkeypatch.setattr(treebpe, "_BLOCK", 37)
    assert np.frombuffer(treebpe.encode_texts(m, [text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def _alignment(texts):
    """Plain version: whole texts, offsets by sets, links one by one."""
    import re

    import sentencepiece
    from tokenizers import Tokenizer

    paths = tokenalign.default_paths()
    a_lib, b_lib = Tokenizer.from_file(paths["a_path"]), sentencepiece.SentencePieceProcessor(model_file=paths["b_path"])
    a_lib.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        a = a_lib.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(byte[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in ((i, b_lib.id_to_piece(i)) for i in b_lib.encode(text))]
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            out.append(([], []))
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for high in shared:
            groups.append(tuple([i for (i, _), e in zip(side, ee) if low < e <= high] for side, ee in zip((a, b), ends)))
            low = high
        out.append((groups, [pair for x, y in groups for pair in product(x, y)]))
    held = Counter(pair for _, links in out for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for groups, links in out:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sums = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links)
        rows.append((*sums, hashlib.sha256(said.encode()).hexdigest() if groups else "", said))
    return rows, held


@pytest.mark.parametrize("chunk", [40, 4_000_000])
def test_token_alignment_is_the_plain_one(spark, odd, chunk):
    paths = tokenalign.default_paths()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want, held = _alignment([t for _, t in texts])
    out = tokenalign.score(odd, **paths, chunk=chunk).collect()
    found = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out)
    assert found == sorted((str(i), *w[:-1]) for (i, _), w in zip(texts, want))
    spoken = sorted((str(r.doc_id), r.groups, sum(x.n for x in r.links)) for r in tokenalign.align(odd, **paths, chunk=chunk).collect())
    assert spoken == sorted((str(i), w[-1], w[3]) for (i, _), w in zip(texts, want))
    assert {(r.a, r.b): r.docs for r in tokenalign.pair_counts(odd, **paths, chunk=chunk).collect()} == dict(held)


def test_token_alignment_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    want, _ = _alignment([r.text for r in docs.orderBy("doc_id").collect()])
    out = tokenalign.op11_token_alignment(spark, sf).orderBy("doc_id").collect()
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out] == [w[:-1] for w in want]


def test_token_alignment_of_odd_tables(spark, odd):
    paths = tokenalign.default_paths()
    assert tokenalign.score(odd.where("false"), **paths).count() == 0
    none = tokenalign.score(odd.where("text IS NULL OR text = ''"), **paths).collect()
    assert none and all((r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, "") for r in none)


def _audit(rows, top):
    """Plain version in whole numbers."""
    import re

    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = (x or "" for x in (text, lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        mine = [s for x, s in groups if x == lang]
        whole = sum((counts[lang, s] for s in mine), Counter())

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        by, q = {s: p(counts[lang, s]) for s in mine}, p(whole)
        f = lambda x, y: (x - y) ** 2 // y
        for s in mine:
            pair = sorted((-sum(f(by[s][t], by[o][t]) for t in kept), o.encode()) for o in mine if o != s)
            term = sorted((-f(by[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and by[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, got in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(got)]
    return sorted(out)


def test_divergence_is_the_plain_one(spark):
    rng = np.random.default_rng(5)
    names, rows = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "K", "中"], []
    for i in range(400):
        words = rng.choice(names, rng.integers(0, 30), p=np.arange(1, len(names) + 1)[::-1] / sum(range(len(names) + 1)))
        rows.append((" ".join(w.upper() if rng.random() < 0.2 else w for w in words), ["en", "de", None][i % 3], [f"s{int(rng.integers(0, 12))}", None][i % 9 == 0]))
    rows += [(None, None, None), ("", "xx", "a"), ("only twice", "xx", "b"), ("only twice", "xx", "c"), ("1 2 [] @", "en", "empty"), (None, "en", "nul"), *[("rare", "yy", "one")] * 3]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS s").repartition(5)
    for top in (5, 200):
        found = sorted(tuple(r) for r in divergence.audit(docs, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
        assert found == _audit(rows, top)
    assert divergence.audit(docs.where("false")).count() == 0
    assert divergence.audit(docs.where("source IS NULL AND text IS NULL")).count() == 0


def test_dense_tiles_and_posting_pairs_add_up_alike():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 9, 60)
    s = np.concatenate([rng.permutation(11)[:n] + 1 for n in size])
    low = rng.integers(1, 50, 12)
    p, p0 = rng.integers(1, 10**9, len(s)), low[s]
    want = Counter()
    for at, n in zip(np.cumsum(size) - size, size):
        for i, j in product(range(at, at + n), repeat=2):
            if i != j:
                f = lambda x, y: (int(x) - int(y)) ** 2 // int(y)
                want[int(s[i]), int(s[j])] += f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
    for way in (divergence._dense, divergence._sparse):
        a, b, v = way(size, s, p, p0)
        assert {k: n for *k_, n in zip(a.tolist(), b.tolist(), v.tolist()) if n for k in [tuple(k_)]} == {k: n for k, n in want.items() if n}


def test_words_are_counted_the_same_in_small_blocks(monkeypatch):
    text = "Añb c1d é " * 40
    monkeypatch.setattr(divergence, "_BLOCK", 7)
    assert [w for b in divergence._blocks(text.encode().lower()) for w in divergence._TERM.findall(b)] == divergence._TERM.findall(text.encode().lower())


def test_training_reads_one_row_of_an_id(spark, monkeypatch):
    """Twenty thousand documents share an id: one text of it reaches the driver, the same one in any order."""
    from pyspark.sql import functions as F

    from turnwise.llm import langid, quality

    many = spark.range(20_000).selectExpr("7L AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    others = spark.range(40).selectExpr("id + 100 AS doc_id", "concat('other ', id) AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    docs = many.unionByName(others)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    seen = []
    original = type(docs).toPandas

    def spy(self):
        seen.append(original(self))
        return seen[-1]

    monkeypatch.setattr(type(docs), "toPandas", spy)
    for table_ in (docs, docs.repartition(7)):
        quality.train(table_, labels, steps=1)
        langid.train(table_)
    assert all(f["k"].is_unique and len(f) <= 41 for f in seen) and len(seen) == 4
    assert seen[0]["t"].tolist() == seen[2]["t"].tolist() and seen[1]["t"].tolist() == seen[3]["t"].tolist()


# --- personal data, found by a reading of its own -------------------------------------------------


def test_names_of_all_shapes_are_replaced(spark):
    """Written by hand: what must be gone, what must stay, and which words must get one surrogate."""
    rows = [
        ("Mrs McDonald met Mr O'Neil.", ["McDonald", "Neil"], ["Mrs ", " met Mr O'"]),
        ("MR SMITH, Dr Smith and Prof. Dr. Smith", ["SMITH", "Smith"], ["MR ", ", Dr ", " and Prof. Dr. "]),
        ("Mr Jean-Pierre Dupont, then Dupont said.", ["Jean", "Pierre", "Dupont"], ["Mr ", ", then ", " said."]),
        ("Frau Müller-Lüdenscheidt kam, Müller ging.", ["Müller", "Lüdenscheidt"], ["Frau ", " kam, ", " ging."]),
        ("Mr Smith met Smith and John Smith, not Smithson; SMITH.", ["Mr Smith", "met Smith", "John Smith", "SMITH"], ["Smithson", "John "]),
        ("Herr von der Leyen, Ms J. R. Huber", ["Leyen", "Huber"], ["Herr von der ", ", Ms J. R. "]),
        ("at 2001:0db8:85a3:0000:0000:8a2e:0370:7334 or fe80::1ff:fe23:4567:890a", ["85a3", "fe80", "890a"], ["at ", " or "]),
        ("std::abs at 12:30:45, a::b", [], ["std::abs at 12:30:45, a::b"]),
        ("GB82 WEST 1234 5698 7654 32 or DE89370400440532013000", ["82 WEST 1234", "5698", "3704004405"], ["GB", " WEST ", " or DE"]),
        ("Mr here and the Smith of it, AB12 CDEF GHIJ KLMN", [], ["Mr here and the Smith of it, AB12 CDEF GHIJ KLMN"]),
        ("господин Иванов и Иванов", ["Иванов"], ["господин ", " и "]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    first = [r.text for r in pii.pseudonymise(docs, key="k").orderBy("doc_id").collect()]
    for (text, gone, stay), out in zip(rows, first, strict=True):
        assert not [g for g in gone if g in out] and not [s for s in stay if s not in out], (text, out)
        assert gone or text == out
    assert first == [r.text for r in pii.pseudonymise(docs, key="k").orderBy("doc_id").collect()] and first != [r.text for r in pii.pseudonymise(docs, key="other").orderBy("doc_id").collect()]
    smith = first[4].split()[1]
    assert first[4] == f"Mr {smith} met {smith} and John {smith}, not Smithson; {smith.upper()}." and first[1] == f"MR {smith.upper()}, Dr {smith} and Prof. Dr. {smith}"
    one = first[2].split()
    assert one[2].rstrip(",") == one[4] and one[1].count("-") == 1
    assert first[3].split("-")[0].split()[-1] == first[3].split()[-2]


def test_the_key_is_not_in_the_plan(spark, capsys):
    docs = spark.createDataFrame([(1, "Mr Smith, a@b.org"), (2, "Mrs Jones")], "doc_id long, text string")
    pii.pseudonymise(docs, key="VERYSECRETKEY").explain("extended")
    assert "VERYSECRETKEY" not in capsys.readouterr().out
