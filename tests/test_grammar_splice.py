"""Grammar and splice against a plain stack parser, a plain automaton and a plain graph test."""

import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import splice
from turnwise.sources import grammar, transcripts

LINES = [
    "<the <big bad> [//] dog> [/] [?] cat [: kitten x] <a [: b] c> [= note <x>] (.) goes , +... \x150_10\x15", "+< > a < b [//] [- spa] no [x 3] .", "[?] hi [*] < <x> y> z .", "", "word", "<<<a>>> [//] .",
    "<a> [: b c] <(.) d e> [: f] <g [: h] i> [:: j] .", "] [ a\x15 b", "< > [//] x ?", "a <b> > > c <d <e> [/]", "&-um (be)cause 0is ice+cream@s:fra ‡ yes , +/.",
]


def _lines(spark, texts):
    return spark.createDataFrame([(f"f{i % 3}", i, "utterance", "CHI", t) for i, t in enumerate(texts)], "file string, line_no int, kind string, label string, text string")


def _stack(kinds):
    """Partners by a stack; kinds of tokens in order."""
    stack, partner = [], {}
    for i, k in enumerate(kinds):
        if k == "open":
            stack.append(i)
        elif k == "close" and stack:
            j = stack.pop()
            partner[i], partner[j] = j, i
    return partner


def _random_lines(n):
    rng = random.Random(4)
    parts = ["<", ">", "<", ">", "[//]", "[/]", "[: x y]", "[?]", "a", "b", "don't", "(.)", ",", "[- spa]", "+<"]
    return [" ".join(rng.choices(parts, k=rng.randint(0, 25))) + " ." for _ in range(n)]


def test_groups_are_those_of_a_stack(spark):
    rows = grammar.tokens(_lines(spark, LINES + _random_lines(200))).collect()
    lines = {}
    for r in sorted(rows, key=lambda r: (r.line_no, r.pos)):
        lines.setdefault(r.line_no, []).append(r)
    for line in lines.values():
        want = _stack([r.kind for r in line])
        for r in line:
            assert r.partner == want.get(r.pos)
            assert (r.error in ("unopened", "unclosed")) == (r.kind in ("open", "close") and r.pos not in want)


def test_scopes_and_flags_are_those_of_a_recursive_reading(spark):
    read = grammar.tokens(_lines(spark, LINES + _random_lines(200)))
    lines, spoken = {}, {(r.line_no, r.pos): r for r in grammar.words(read).collect()}
    for r in sorted(read.collect(), key=lambda r: (r.line_no, r.pos)):
        lines.setdefault(r.line_no, []).append(r)
    found = {(r.line_no, r.pos): (r.code, r.from_pos, r.to_pos) for r in grammar.annotations(read).collect()}
    for no, line in lines.items():
        partner, retraced, replaced = _stack([r.kind for r in line]), set(), {}
        for r in line:
            if r.kind != "annotation":
                continue
            k = r.pos - 1
            while k >= 0 and line[k].kind == "annotation":
                k -= 1
            scope = None
            code = found[no, r.pos][0]
            if code not in "+-^" and k >= 0:
                if line[k].kind == "word":
                    scope = (k, k)
                elif line[k].kind == "close" and k in partner:
                    scope = (partner[k] + 1, k - 1)
            assert found[no, r.pos][1:] == (scope or (None, None))
            if scope and code.startswith("/"):
                retraced |= set(range(scope[0], scope[1] + 1))
            if scope and code in (":", "::"):
                for p in range(scope[0], scope[1] + 1):
                    replaced[p] = True
        for r in line:
            if r.kind == "word":
                assert spoken[no, r.pos].retraced == (r.pos in retraced)
                assert spoken[no, r.pos].replaced == (r.pos in replaced)
    said = {(r.word, r.line_no): r.replacement for r in spoken.values() if r.replacement}
    assert said["cat", 0] == ["kitten", "x"] and said["a", 0] == ["b"] and said["d", 6] == ["f"]


def test_reading_rendering_reading_is_the_identity(spark):
    lines = _lines(spark, LINES + _random_lines(100))
    once = grammar.tokens(lines)
    again = grammar.tokens(lines.drop("text").join(grammar.render(once), ["file", "line_no"]))
    flat = lambda t: sorted(tuple(r) for r in t.na.fill(-1, ["partner"]).na.fill("", ["error"]).collect())
    assert flat(once) == flat(again)


def test_parse_gives_whole_utterances(spark):
    out = {r.line_no: r for r in grammar.parse(_lines(spark, LINES)).collect()}
    assert len(out) == len(LINES) and out[0].terminator == "+..." and out[0].errors == []
    assert [w.word for w in out[0].words] == ["the", "big", "bad", "dog", "cat", "a", "c", "goes"] and [w.retraced for w in out[0].words] == [True] * 4 + [False] * 4
    assert "unopened" in out[1].errors and "unclosed" in out[1].errors and out[2].errors == ["nothing before"] and out[3].words is None


# A plain regular expression of the same words; \w of ``regex`` is not needed.
def _plain_word():
    import regex

    a, letter = "['’ˈˌ]", r"[\p{L}\p{M}]"
    cut = rf"\({a}*{letter}(?:{letter}|{a}|:)*\)"
    core = rf"{a}*(?:{letter}|{cut})(?:{letter}|{a}|:|{cut}|[-~+_^]{a}*(?:{letter}|{cut}))*"
    return regex.compile(rf"(?:0|(?:&[-~+]|0)?{core}(?:@[a-z]+(?::[a-z]+(?:[+&][a-z]+)*)?)?(?:\$[a-z]+(?::[a-z]+)*)?)")


WORDS = ["", "hello", "0", "00", "0is", "&-um", "&", "(be)cause", "runnin(g)", "(", "a(b", "ice+cream", "+a", "a_", "don't", "'cause", "'", "x:", "dog@s:spa+eng", "dog@s:", "dog@S", "run$v:x", "run$", "a1", "a<b", "ca^t", "é", "é", "中", "(.)", "a()b", "a-('b)c", "&~(a)b@s:fra$n", "\n", "a\nb", "😀a"]


def test_verdicts_are_those_of_a_plain_expression(spark):
    rng = random.Random(9)
    words = WORDS + ["".join(rng.choices("aB'é:-+_()0&@$1~ ", k=rng.randint(1, 7))) for _ in range(600)]
    form = _plain_word()
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string").select("word", grammar.verdict(F.col("word")).alias("v"), grammar.sanitised(F.col("word")).alias("s")).collect()

    def rebuilt(word):
        out = ""
        for c in word:
            if form.fullmatch(out + c):
                out += c
        return out or None

    for r in rows:
        word = r.word or ""
        assert r.v.ok == bool(form.fullmatch(word)), word
        assert r.s == (None if r.word is None else word if r.v.ok else rebuilt(word)), word
        if not r.v.ok:  # nothing that begins with the part up to ``at`` is a word; the part before it can still become one
            going = form.fullmatch(word[: r.v.at], partial=True)
            assert not going if r.v.at <= len(word) else form.fullmatch(word, partial=True), word
            assert form.fullmatch(word[: r.v.at - 1], partial=True), word
    digits = spark.createDataFrame([("a1",)], "word string").select(grammar.verdict(F.col("word"), True).alias("v")).first().v
    assert digits.ok


def test_utterances_with_bad_words_are_set_aside(spark):
    utts = spark.createDataFrame([("f", 0, ["a", "b"]), ("f", 1, ["a", "b<", "$"]), ("f", 2, []), ("f", 3, None)], "file string, utt int, words array<string>")
    good, bad = grammar.accepted(utts)
    assert sorted(r.utt for r in good.collect()) == [0, 2, 3] and [tuple(r) for r in bad.collect()] == [("f", 1, 1, "b<", 2, "character")]


# --- splice ------------------------------------------------------------------------


def _tree(rng, n):
    order = list(range(1, n + 1))
    rng.shuffle(order)
    return {w: 0 if not k else order[rng.randrange(k)] for k, w in enumerate(order)}


def _case(seed):
    rng = random.Random(seed)
    host, second = [], []
    for utt in range(60):
        n = rng.randint(1, 12)
        heads, langs = _tree(rng, n), [rng.choice([None, None, "spa", "spa", "fra"]) for _ in range(n)]
        if utt % 15 == 14:
            heads[1] = 1  # no tree
        for i in range(1, n + 1):
            host.append(("f", utt, i, f"h{i}", f"l{i}", rng.choice(["NOUN", "VERB", "ADJ"]), heads[i], "root" if heads[i] == 0 else rng.choice(["obj", "advmod", "flat", "nmod"]), langs[i - 1]))
        span, at = 0, 0
        while at < n:
            end = at
            while end < n and langs[end] == langs[at]:
                end += 1
            if langs[at]:
                span += 1
                sizes = [rng.choice([1, 1, 1, 2]) for _ in range(at, end)]
                if rng.random() < 0.15:
                    sizes.append(1)  # one word too many
                m = sum(sizes)
                tree = _tree(rng, m)
                word = [w + 1 for w, s in enumerate(sizes) for _ in range(s)]
                for i in range(1, m + 1):
                    head = tree[i] if rng.random() > 0.1 else rng.randint(0, m + 1)
                    second.append(("f", utt, span, i, word[i - 1], f"s{i}", f"m{i}", rng.choice(["NOUN", "VERB", "ADP"]), head, "root" if head == 0 else "obj"))
                if rng.random() < 0.1:
                    second = [r for r in second if r[:3] != ("f", utt, span)]  # no parse came back
            at = end
    return host, second


HOST = "file string, utt int, id int, text string, lemma string, upos string, head int, deprel string, lang string"
SECOND = "file string, utt int, span int, id int, word int, text string, lemma string, upos string, head int, deprel string"


@pytest.mark.parametrize("seed", [1, 2])
def test_spliced_trees_are_whole(spark, seed):
    host, second = _case(seed)
    out = splice.splice(spark.createDataFrame(host, HOST), spark.createDataFrame(second, SECOND)).collect()
    by, given = {}, {}
    for r in out:
        by.setdefault(r.utt, []).append(r)
    for r in host:
        given.setdefault(r[1], []).append(r)
    assert {r.origin for r in out} == {"host", "spliced", "fallback"}
    for utt, rows in by.items():
        rows.sort(key=lambda r: r.id)
        assert [r.id for r in rows] == list(range(1, len(rows) + 1))
        heads = {r.id: r.head for r in rows}
        if utt % 15 == 14:
            assert all(r.origin != "spliced" for r in rows) and len(rows) == len(given[utt])
            continue
        assert sum(h == 0 for h in heads.values()) == 1
        for i in heads:  # every walk ends at the root
            seen = set()
            while i and i not in seen:
                seen.add(i)
                i = heads[i]
            assert i == 0
        for r in rows:
            assert (r.head == 0) == (r.deprel == "root")
            if r.origin == "fallback":
                assert (r.upos, r.lemma) == ("L2", "xxx")
        hosts = [r.text for r in rows if r.origin != "spliced"]
        assert hosts == [r[3] for r in given[utt] if r[3] in hosts]  # host words keep their order
        # relations between host words outside spans stay
        place = {r.text: r.id for r in rows if r.origin == "host"}
        for r in given[utt]:
            if r[3] in place and f"h{r[6]}" in place:
                assert heads[place[r[3]]] == place[f"h{r[6]}"]


def test_splice_by_hand(spark):
    # "I want la fecha bien now": la and bien on fecha, fecha where the first of them hung
    host = [("f", 0, i + 1, t, t, u, h, d, g) for i, (t, u, h, d, g) in enumerate([
        ("I", "PRON", 2, "nsubj", None), ("want", "VERB", 0, "root", None), ("la", "X", 4, "flat", "spa"), ("fecha", "X", 2, "flat", "spa"), ("dela", "X", 4, "flat", "spa"), ("now", "ADV", 2, "advmod", None)])]
    second = [("f", 0, 1, i + 1, w, t, t, u, h, d) for i, (w, t, u, h, d) in enumerate([(1, "la", "DET", 2, "det"), (2, "fecha", "NOUN", 0, "root"), (3, "de", "ADP", 4, "case"), (3, "la", "DET", 2, "nmod")])]
    out = splice.splice(spark.createDataFrame(host, HOST), spark.createDataFrame(second, SECOND))
    tier = splice.tiers(out).first()
    assert tier.mor == "pron|I verb|want det|la noun|fecha adp|de det|la adv|now"
    assert tier.gra == "1|2|NSUBJ 2|0|ROOT 3|4|DET 4|2|OBJ 5|6|CASE 6|4|NMOD 7|2|ADVMOD"
    alone = splice.splice(spark.createDataFrame(host, HOST), spark.createDataFrame(second[:2], SECOND))
    assert splice.tiers(alone).first().mor == "pron|I verb|want L2|xxx L2|xxx L2|xxx adv|now"


def test_classes_are_chosen_in_order(spark):
    cases = [  # first, second, relation, dependents, particle, head of a particle, wanted
        ("NOUN", "ADP", "advmod", [], True, False, "PART"), ("NOUN", "VERB", "advmod", [], False, True, "VERB"), ("NOUN", "VERB", "root", ["cop"], False, False, "NOUN"), ("ADJ", "VERB", "root", ["cop"], False, False, "ADJ"),
        ("VERB", "NOUN", "obj", [], False, False, "NOUN"), ("NOUN", "DET", "obj", [], False, False, "DET"), ("ADV", "NOUN", "advmod", [], False, False, "NOUN"), ("NOUN", "VERB", "obj", [], False, False, "NOUN"),
        ("VERB", "ADJ", "obj", [], False, False, "NOUN"), ("X", "ADJ", "flat", [], False, False, "ADJ"), ("X", "ADJ", "flat", ["det"], False, False, "NOUN"), (None, None, "flat", [], False, False, "NOUN"), ("VERB", None, "nsubj", [], False, False, "NOUN"),
    ]
    df = spark.createDataFrame(cases, "a string, b string, d string, k array<string>, p boolean, h boolean, want string")
    bad = df.withColumn("got", splice.merged_class(*[F.col(c) for c in "abdkph"])).where("got <> want").collect()
    assert not bad
