"""Main lines of transcripts as tokens, nested groups, scoped annotations and judged words.

A main line is a row of tokens: words, groups ``<...>`` which may nest, annotations ``[...]``
that act on the word or group before them, pauses, separators, linkers, a terminator, a time
mark. The usual parser keeps a stack. Here each step is a window over the tokens of
a line, linear in its length:

* the depth of the stack is the running balance of ``<`` and ``>`` above its running minimum,
  so that a stray ``>`` is set aside as a parser would;
* brackets of one level alternate, so that a ``>`` closes the bracket before it on its level;
* an annotation acts on the last token before it that is no annotation;
* whether a word lies inside a scope is a running sum over scope starts and ends.

Words are judged by a finite automaton (``verdict``), which also drives the removal of
characters that no word can hold (``sanitised``). Everything is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of the transcript format.
BULLET = "\x15\\d+_\\d+\x15"
TERMINATOR = r"\+(?:\.\.\.|\.\.\?|//\.|//\?|/\.|/\?|!\?|\"/\.|\"\.|\.)|[.?!](?=\s|$)"
LINKER = r"\+[<^,\"+](?=\s|$)|\+≈|\+≋"
PAUSE = r"\(\.{1,3}\)|\(\d+(?::\d+)?(?:\.\d*)?\)"
SEPARATOR = r"[,;:‡„](?=\s|$)"
ANNOTATION = r"\[[^\[\]]*\]"
WORD = r"[^\s<>\[\]\x15]+"
CODE = r"^\[\s*(///|//|/-|/|::|:|=!|=\?|=|%|\*|!!|!|\?|[<>]\d*|\+|-|\^|#|x)\s*(.*?)\s*\]$"
#: Codes that set the words before them aside as not meant.
RETRACES = ["/", "//", "///", "/-"]
#: Codes that belong to the whole utterance and have no scope.
WHOLE = ["+", "-", "^"]

#: Characters of the lines that one task parses.
_SHARE = 1_000_000

_TOKEN = "|".join([BULLET, ANNOTATION, LINKER, TERMINATOR, PAUSE, SEPARATOR, WORD, r"[<>\[\]]", "\x15"])
_KINDS = [("bullet", BULLET), ("annotation", ANNOTATION), ("open", "<"), ("close", ">"), ("linker", LINKER), ("terminator", TERMINATOR), ("pause", PAUSE), ("separator", SEPARATOR), ("word", WORD)]


def kind_of(token: Column) -> Column:
    out = F.lit("error")
    for kind, form in reversed(_KINDS):
        out = F.when(token.rlike(f"^(?:{form})$"), kind).otherwise(out)
    return out


def tokens(lines: DataFrame) -> DataFrame:
    """file, line_no, pos, kind, text, level, partner, error of the utterance lines of ``transcripts.lines_of``.

    ``level``: depth inside groups (a bracket counts as inside itself); ``partner``: position of
    the other bracket; ``error``: ``unopened``, ``unclosed``, ``stray`` or null. A null text has no tokens.
    """
    said = lines.where("kind = 'utterance'").select("file", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))).alias("pos", "text"))
    line, order = Window.partitionBy("file", "line_no"), Window.partitionBy("file", "line_no").orderBy("pos")
    step = (F.col("kind") == "open").cast("int") - (F.col("kind") == "close").cast("int")
    rows = said.withColumn("kind", kind_of(F.col("text"))).withColumn("sum", F.sum(step).over(order)).withColumn("low", F.least(F.lit(0), F.min("sum").over(order)))
    rows = rows.withColumn("stray", (F.col("kind") == "close") & (F.col("sum") < F.coalesce(F.lag("low").over(order), F.lit(0))))
    rows = rows.withColumn("level", F.col("sum") - F.col("low") + F.when((F.col("kind") == "close") & ~F.col("stray"), 1).otherwise(0))
    bracket = F.col("kind").isin("open", "close") & ~F.col("stray")
    same = Window.partitionBy("file", "line_no", bracket, "level").orderBy("pos")
    next_kind = F.lead("kind").over(same)
    partner = F.when(bracket & (F.col("kind") == "close"), F.lag("pos").over(same)).when(bracket & (F.col("kind") == "open") & (next_kind == "close"), F.lead("pos").over(same))
    error = F.when(F.col("stray"), "unopened").when((F.col("kind") == "open") & F.col("partner").isNull(), "unclosed").when(F.col("kind") == "error", "stray")
    return rows.withColumn("partner", partner).withColumn("error", error).select("file", "line_no", "pos", "kind", "text", F.col("level").cast("int").alias("level"), "partner", "error")


def _acting(read: DataFrame) -> DataFrame:
    """``read`` with code, value, from_pos, to_pos and lost (an error) of its annotations; null for other tokens."""
    before = Window.partitionBy("file", "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(F.col("kind") != "annotation", F.struct("pos", "kind", "partner")), ignorenulls=True).over(before)
    noted = F.col("kind") == "annotation"
    code, value = (F.when(noted, F.regexp_extract("text", CODE, i)) for i in (1, 2))
    rows = read.withColumn("base", base).withColumns({"code": F.when(code == "", "other").otherwise(code), "value": F.when(code == "", F.expr("substring(text, 2, length(text) - 2)")).otherwise(value)})
    scoped = noted & ~F.col("code").isin(WHOLE)
    first = F.when(scoped & (F.col("base.kind") == "close"), F.col("base.partner") + 1).when(scoped & (F.col("base.kind") == "word"), F.col("base.pos"))
    last = F.when(scoped & (F.col("base.kind") == "close"), F.when(F.col("base.partner").isNotNull(), F.col("base.pos") - 1)).when(scoped & (F.col("base.kind") == "word"), F.col("base.pos"))
    return rows.withColumns({"from_pos": first, "to_pos": last, "lost": F.when(scoped & first.isNull(), "nothing before")}).drop("base")


def annotations(read: DataFrame) -> DataFrame:
    """file, line_no, pos, code, value, from_pos, to_pos, error: what each annotation acts on (positions of tokens, inclusive)."""
    return _acting(read).where("kind = 'annotation'").select("file", "line_no", "pos", "code", "value", "from_pos", "to_pos", F.col("lost").alias("error"))


def _scoped(read: DataFrame) -> DataFrame:
    """``_acting`` with retraced, uncertain, replaced and replacement of every token.

    A scope adds a row where it begins and one behind its end; the tokens follow from running sums over both, so that
    nothing is joined.
    """
    kinds = {"r": F.col("code").isin(RETRACES), "u": F.col("code") == "?", "p": F.col("code").isin(":", "::")}
    sign = lambda k: [(F.coalesce(t.cast("int"), F.lit(0)) * k).alias(n) for n, t in kinds.items()]
    token = F.struct("kind", "text", "error", "code", "value", "from_pos", "to_pos", "lost")
    said = F.struct(F.col("from_pos").alias("pos"), (-F.col("to_pos")).alias("less"), F.col("pos").alias("at"), "value")  # the smallest scope from the last place; of equal ones the last
    event = lambda pos, t, k, s: F.struct(pos.alias("pos"), t.alias("t"), *sign(k), s.alias("said"))
    own = event(F.col("pos"), token, 0, F.when(F.lit(False), said))
    begin = event(F.col("from_pos"), F.when(F.lit(False), token), 1, F.when(kinds["p"], said))
    end = event(F.col("to_pos") + 1, F.when(F.lit(False), token), -1, F.when(F.lit(False), said))
    events = _acting(read).select("file", "line_no", F.explode_outer(F.filter(F.array(own, begin, end), lambda e: e["pos"].isNotNull())).alias("e")).select("file", "line_no", "e.*")
    order = Window.partitionBy("file", "line_no").orderBy("pos")
    inside = {n: F.sum(c).over(order) > 0 for c, n in (("r", "retraced"), ("u", "uncertain"), ("p", "replaced"))}
    rows = events.withColumns({**inside, "from": F.max("said").over(order)}).where("t IS NOT NULL").select("file", "line_no", "pos", "t.*", *inside, "from")
    # a scope that begins with a bracket or a pause hands its replacement to the first word in it
    word = F.col("kind") == "word"
    before = F.last(F.when(word, F.col("from.pos")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    one = word & ~before.eqNullSafe(F.col("from.pos"))
    return rows.withColumn("replacement", F.when(F.col("replaced") & one, F.split("from.value", r"\s+"))).drop("from")


_WORD = ["retraced", "uncertain", "replaced", "replacement"]


def words(read: DataFrame) -> DataFrame:
    """file, line_no, pos, word, retraced, uncertain, replaced, replacement.

    ``replaced``: the word stands in the scope of a replacement; its first word carries the
    ``replacement``'s words as an array, others null.
    """
    return _scoped(read).where("kind = 'word'").select("file", "line_no", "pos", F.col("text").alias("word"), *_WORD)


def render(read: DataFrame) -> DataFrame:
    """file, line_no, text: one space between tokens, none inside group brackets. Reading it again gives the same tokens."""
    each = F.array_sort(F.collect_list(F.struct("pos", "kind", "text")))

    def glued(t: Column, i: Column) -> Column:
        before = F.get("t", i - 1)["kind"]
        none = (i == 0) | (before == "open") | ((t["kind"] == "close") & before.isin("word", "close", "annotation", "pause"))
        return F.concat(F.when(none, "").otherwise(" "), t["text"])

    return read.groupBy("file", "line_no").agg(each.alias("t")).select("file", "line_no", F.array_join(F.transform("t", glued), "").alias("text"))


# The automaton of a word. Classes of characters, in the order of the columns below:
#   a ASCII small letter, L other letter or mark, ' apostrophe or stress, : length, - hyphen or tilde, + plus,
#   _ underscore or caret, ( ), 0, &, @, $, x anything else (digits too, unless allowed).
_SPECIALS = {"'": "'’ˈˌ", ":": ":", "-": "-~", "+": "+", "_": "_^", "(": "(", ")": ")", "0": "0", "&": "&", "@": "@", "$": "$"}
_CLASSES = "aL':-+_()0&@$x"
_MOVES = {  # state: {classes: next state}; anything else is the end
    "start": {"aL": "body", "'": "before", "(": "cut", "0": "omitted", "&": "marked"},
    "body": {"aL':": "body", "-+_": "joined", "(": "cut", "@": "form", "$": "part"},
    "before": {"aL": "body", "'": "before", "(": "cut"},
    "joined": {"aL": "body", "'": "joined", "(": "cut"},
    "cut": {"aL": "in cut", "'": "cut"},
    "in cut": {"aL':": "in cut", ")": "body"},
    "omitted": {"aL": "body", "'": "before", "(": "cut"},
    "marked": {"-+": "before"},
    "form": {"a": "in form"},
    "in form": {"a": "in form", ":": "code", "$": "part"},
    "code": {"a": "in code"},
    "in code": {"a": "in code", "+&": "code", "$": "part"},
    "part": {"a": "in part"},
    "in part": {"a": "in part", ":": "part"},
}
_ACCEPTED = {"body", "omitted", "in form", "in code", "in part"}
_STATES = [*_MOVES, "end"]
_REASONS = {"start": "empty", "joined": "nothing joined", "cut": "shortening without letters", "in cut": "shortening not closed", "before": "no letter", "marked": "no letter", "form": "form without a name",
            "code": "language without a code", "part": "class without a name"}


def _table() -> str:
    """The moves as text: one letter (A is the first state) for each state and class."""
    out = []
    for state in _STATES:
        to = {c: t for cs, t in _MOVES.get(state, {}).items() for c in cs}
        out += [chr(65 + _STATES.index(to.get(c, "end"))) for c in _CLASSES]
    return "".join(out)


def _class(c: Column, digits: bool) -> Column:
    out = F.when(c.between("a", "z"), 0).when(c.rlike(r"^[\p{L}\p{M}]" + ("|^[1-9]" if digits else "")), 1)
    for name, members in _SPECIALS.items():
        out = out.when(F.instr(F.lit(members), c) > 0, _CLASSES.index(name))
    return out.otherwise(_CLASSES.index("x"))


def _next(state: Column, c: Column, digits: bool) -> Column:
    """State after a character; states are numbered from 0."""
    return F.ascii(F.substring(F.lit(_table()), state * len(_CLASSES) + _class(c, digits) + 1, F.lit(1))) - 65


_END = _STATES.index("end")


def _accepts(state: Column) -> Column:
    return state.isin([_STATES.index(s) for s in _ACCEPTED])


def verdict(word: Column, digits: bool = False) -> Column:
    """struct<ok, at, reason>: whether a word is well formed; else the first character (from 1) that cannot follow, or one past
    the end where something is missing, and why. ``digits``: words of the language may hold digits. Null and empty words are ``empty``."""
    chars = F.regexp_extract_all(F.coalesce(word, F.lit("")), F.lit("(?s)."), F.lit(0))

    def step(a: Column, c: Column) -> Column:
        to = _next(a["state"], c, digits)
        going = a["at"] == 0
        return F.struct(F.when(going & (to != _END), to).otherwise(a["state"]).alias("state"), F.when(going & (to == _END), a["seen"] + 1).otherwise(a["at"]).alias("at"), (a["seen"] + 1).alias("seen"))

    end = F.aggregate(chars, F.struct(F.lit(0).alias("state"), F.lit(0).alias("at"), F.lit(0).alias("seen")), step)
    missing = F.element_at(F.create_map(*[F.lit(x) for s, r in _REASONS.items() for x in (_STATES.index(s), r)]), end["state"])
    ok = (end["at"] == 0) & _accepts(end["state"])
    reason = F.when(ok, None).when(end["at"] > 0, "character").otherwise(missing)
    return F.struct(ok.alias("ok"), F.when(ok, None).when(end["at"] > 0, end["at"]).otherwise(end["seen"] + 1).alias("at"), reason.alias("reason"))


def sanitised(word: Column, digits: bool = False) -> Column:
    """A well-formed word as it is; else the characters, from the left, that leave a well-formed word each time (null where none is left)."""
    chars = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))

    def step(a: Column, c: Column) -> Column:
        to = _next(a["state"], c, digits)
        keep = _accepts(to)
        return F.struct(F.when(keep, to).otherwise(a["state"]).alias("state"), F.when(keep, F.concat(a["out"], c)).otherwise(a["out"]).alias("out"))

    kept = F.aggregate(chars, F.struct(F.lit(0).alias("state"), F.lit("").alias("out")), step)["out"]
    return F.when(verdict(word, digits)["ok"], word).otherwise(F.nullif(kept, F.lit("")))


def bad_words(spoken: DataFrame, word: str = "word", digits: bool = False) -> DataFrame:
    """word, n, at, reason of the distinct words that are not well formed (each is judged once)."""
    # judged is an aggregate and not the key itself: a filter on the key would be moved below the grouping, to every word
    distinct = spoken.groupBy(F.col(word).alias("_key")).agg(F.max(word).alias("word"), F.count("*").alias("n"))
    return distinct.withColumn("verdict", verdict(F.col("word"), digits)).where("NOT verdict.ok").select("word", "n", "verdict.at", "verdict.reason")


def _dealt(lines: DataFrame) -> DataFrame:
    """``lines`` in shares of about ``_SHARE`` characters: the sorts of a task stay as small however many lines there are."""
    spark = lines.sparkSession
    chars = lines.agg(F.sum(F.length("text"))).first()[0] or 0
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return lines.repartition(max(-(-chars // _SHARE), least, 1), "file", "line_no")


def parse(lines: DataFrame) -> DataFrame:
    """file, line_no, speaker, words (array of pos, word, retraced, uncertain, replaced, replacement), terminator, codes, errors."""
    said = _dealt(lines.where("kind = 'utterance'").select("file", "line_no", "kind", "label", "text"))
    word, code = F.col("kind") == "word", F.col("kind") == "annotation"
    some = lambda test, *cols: F.when(F.count_if(test) > 0, F.sort_array(F.collect_list(F.when(test, F.struct(*cols)))))
    each = _scoped(tokens(said)).groupBy("file", "line_no").agg(
        some(word, "pos", F.col("text").alias("word"), *_WORD).alias("words"),
        F.max_by("text", F.when(F.col("kind") == "terminator", F.col("pos"))).alias("terminator"),
        some(code, "pos", "code", "value", "from_pos", "to_pos").alias("codes"),
        F.sort_array(F.collect_list("error")).alias("wrong"), F.sort_array(F.collect_list("lost")).alias("lost"),
    )
    none = lambda c: F.coalesce(c, F.array())
    rows = said.select("file", "line_no", F.col("label").alias("speaker")).join(each, ["file", "line_no"], "left")
    return rows.select("file", "line_no", "speaker", "words", "terminator", "codes", F.concat(none(F.col("wrong")), none(F.col("lost"))).alias("errors"))


def accepted(utts: DataFrame, digits: bool = False) -> tuple[DataFrame, DataFrame]:
    """(utterances whose words are all well formed, rejects with the first bad word): ``utts`` has file, utt and words (array of strings)."""
    judged = utts.withColumn("bad", F.filter(F.transform("words", lambda w, i: F.struct(i.alias("word_no"), w.alias("word"), verdict(w, digits).alias("v"))), lambda x: ~x["v"]["ok"]))
    rejects = judged.where(F.size("bad") > 0).select("file", "utt", F.get("bad", F.lit(0)).alias("b")).select("file", "utt", "b.word_no", "b.word", "b.v.at", "b.v.reason")
    return judged.where((F.size("bad") == 0) | F.col("bad").isNull()).drop("bad"), rejects
