"""Rules that belong to one language: irregular forms, pronoun case, plurals that can be heard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# French pronouns by case; a form in both lists counts as nominative.
FRENCH_NOMINATIVE = ["qui", "je", "tu", "il", "elle", "ils", "elles", "moi", "toi", "lui", "eux"]
FRENCH_ACCUSATIVE = ["que", "quoi", "me", "te", "le", "la", "les", "lui", "leur"]
# Frequent English verbs whose forms follow no rule.
ENGLISH_IRREGULAR = {
    "be": ["am", "are", "is", "was", "were", "been"], "begin": ["began", "begun"], "break": ["broke", "broken"], "bring": ["brought"], "buy": ["bought"],
    "catch": ["caught"], "choose": ["chose", "chosen"], "come": ["came"], "do": ["did", "done", "does"], "draw": ["drew", "drawn"], "drink": ["drank", "drunk"],
    "drive": ["drove", "driven"], "eat": ["ate", "eaten"], "fall": ["fell", "fallen"], "feel": ["felt"], "find": ["found"], "fly": ["flew", "flown"],
    "forget": ["forgot", "forgotten"], "get": ["got", "gotten"], "give": ["gave", "given"], "go": ["went", "gone", "goes"], "grow": ["grew", "grown"], "have": ["had", "has"],
    "hear": ["heard"], "hold": ["held"], "keep": ["kept"], "know": ["knew", "known"], "leave": ["left"], "lose": ["lost"], "make": ["made"], "mean": ["meant"], "meet": ["met"],
    "ride": ["rode", "ridden"], "run": ["ran"], "say": ["said"], "see": ["saw", "seen"], "sell": ["sold"], "send": ["sent"], "sing": ["sang", "sung"], "sit": ["sat"],
    "sleep": ["slept"], "speak": ["spoke", "spoken"], "stand": ["stood"], "swim": ["swam", "swum"], "take": ["took", "taken"], "teach": ["taught"], "tell": ["told"],
    "think": ["thought"], "throw": ["threw", "thrown"], "understand": ["understood"], "wear": ["wore", "worn"], "win": ["won"], "write": ["wrote", "written"],
}


def irregular(lemma: Column, form: Column, table: dict[str, list[str]] | None = None) -> Column:
    """Whether a form of a verb follows no rule (case does not matter; null is no)."""
    known = ENGLISH_IRREGULAR if table is None else table
    forms = F.try_element_at(F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.lower(lemma))
    return F.coalesce(F.array_contains(forms, F.lower(form)), F.lit(False))


def french_case(word: Column) -> Column:
    """Nom, Acc or empty for a French pronoun, by its form alone."""
    bare = F.trim(F.btrim(F.lower(word), F.lit("'")))
    return F.when(bare.isin(FRENCH_NOMINATIVE), "Nom").when(bare.isin(FRENCH_ACCUSATIVE), "Acc").otherwise("")


def heard_plural(word: Column, nouns: list[str]) -> Column:
    """Whether a French noun is one of those whose plural sounds different (-al, -aux); ``nouns`` are the singulars."""
    bare = F.lower(F.trim(word))
    plurals = [n[:-1] + "ux" if n.endswith("al") else n[:-2] + "ux" if n.endswith("ail") else n + "s" for n in nouns]
    return bare.isin([n.lower() for n in nouns] + [p.lower() for p in plurals])
