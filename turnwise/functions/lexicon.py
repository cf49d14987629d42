"""Fixed values of the text rules: word lists, marks, limits and code tables.

They are data that decide results. The large lexicons (compounds, personal
names, abbreviations) are parameters of the functions that use them; the lists
here are small ones of our own that serve as defaults.
"""

from __future__ import annotations

# Words and marks.
FILLERS = ["um", "uhm", "em", "mhm", "uhhm", "eh", "uh", "hm"]
TERMINATORS = [".", "?", "!", "+...", "+/.", "+//.", "+/?", "+!?", "+\"/.", "+\".", "+//?", "+..?", "+."]
SEPARATORS = [",", "‡", "„"]
ENDING_PUNCT = [".", "?", "!", "+...", "+/.", "+//.", "+/?", "+!?", "+\"/.", "+\".", "+//?", "+..?", "+."]
MOR_PUNCT = ["‡", "„", ","]
RTL_PUNCT = {"؟": "?", "۔": ".", "،": ",", "؛": ";"}
LONG_PAUSE_STARTERS = ["and", "but", "so", "well", "then", "okay", "ok", "yeah", "yes", "no", "oh", "now", "because", "i", "you", "he", "she", "it", "we", "they", "this", "that", "there", "what", "when", "where", "who", "why", "how"]
FILLED_PAUSES = {"um": "&-um", "ur": "&-ur", "uh": "&-uh"}
REPLACEMENTS = {"mm-hmm": "mhm", "mm-hum": "mhm", "'em": "(th)em", "cuz": "(be)cause", "'cause": "(be)cause"}
TITLE_SURFACES = ["dr.", "mr.", "mrs.", "prof.", "st.", "mt.", "ave.", "a.m.", "p.m.", "u.s.", "j.f.k.", "ph.d.", "m.d.", "etc.", "e.g.", "i.e."]
PRONOUN_I = {"i": "I", "i'll": "I'll", "i'm": "I'm", "i've": "I've", "i'd": "I'd"}
PERCENT_WORDS = {"eng": "percent", "fra": "pour_cent", "spa": "por_ciento", "deu": "Prozent", "ita": "per_cento", "por": "por_cento", "nld": "procent", "jpn": "パーセント", "zho": "百分", "cmn": "百分", "yue": "百分"}
CURRENCY_PREFIXES = {"$": "dollars", "€": "euros", "£": "pounds", "¥": "yen", "₹": "rupees", "₩": "won", "₽": "rubles"}
CURRENCY_SUFFIXES = {"€": "euros", "₹": "rupees"}

# What a word becomes before it is scored (whole-word rules after the others).
CONFORM_WORDS = {
    "ok": ["okay"], "gimme": ["give", "me"], "hafta": ["have", "to"], "havta": ["have", "to"],
}
CONFORM_LATE = {
    "dunno": ["don't", "know"], "wanna": ["want", "to"], "gonna": ["going", "to"], "gotta": ["got", "to"], "kinda": ["kind", "of"], "sorta": ["sort", "of"],
    "shoulda": ["should", "have"], "sposta": ["supposed", "to"], "hadta": ["had", "to"], "alright": ["all", "right"], "alrightie": ["all", "right"],
    "i'd": ["i", "had"], "this'll": ["this", "will"], "farmhouse": ["farm", "house"], "mm": ["hm"], "hmm": ["hm"], "em": ["them"], "eh": ["uh"],
    "til": ["until"], "ed": ["education"],
}
CONFORM_SPELLED = ["mba", "tli", "bbc", "ai", "aa", "ii"]
CONTRACTIONS = [("'s", "is"), ("'ve", "have"), ("'d", "had"), ("'m", "am")]

# Small lexicons of our own, replaced by tables in real use.
COMPOUNDS = [("air", "port"), ("tooth", "brush"), ("farm", "yard"), ("some", "thing"), ("every", "one"), ("play", "ground")]
NAMES = ["anna", "peter", "maria", "john", "sophie", "lukas"]
ABBREVIATIONS = ["USA", "FBI", "TV", "NASA", "EU", "UN"]

# Limits.
MAX_TURN_WORDS, LONG_PAUSE_MS, LONG_PAUSE_LEAST = 300, 800, 2
DETECT_LETTERS, DETECT_CONFIDENCE, DETECT_UTTERANCES = 40, 0.5, 3
SMALL_GROUP = 3
GROUP_CHARS, GROUP_MS_NARROW, GROUP_MS_WIDE, TRAILING_GAP_MS = 448, 15_000, 20_000, 1_500
ESTIMATE_BUFFER_MS, HUMAN_WPS = 2_000, 15.0
RESCUE_TRIGGER_MS, RESCUE_TARGET_MS, RESCUE_SAFETY_MS = 250, 350, 200
FILLER_EXPANSION_MS = 1_500
HEAL_GAP_MS, LAST_WORD_MS = 1_000, 500
AVERAGE_OVERLAP_MS, FILL_GAP_MS, SAME_SPEAKER_OVERLAP_MS = 500, 1_000, 500
OVERLAP_DENSITY, OVERLAP_BUFFER_MS, FUZZY_MATCH = 0.30, 500, 0.85
RETRY_ATTEMPTS, RETRY_FIRST_S, RETRY_FACTOR, RETRY_CAP_S = 3, 1.0, 2.0, 60.0
ERROR_SAMPLES = 5
RUNAWAY_CHARS_PER_S = 8.0
CHILD_HZ, CHILD_SHARE, ADULT_SHARE, VOICED_FRAMES = 250.0, 0.50, 0.20, 8

# Code tables.
LANG2 = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "jpn": "ja", "zho": "zh", "kor": "ko", "rus": "ru", "cym": "cy", "ara": "ar", "tur": "tr", "pol": "pl", "swe": "sv", "dan": "da", "fin": "fi", "ell": "el", "heb": "he", "hin": "hi"}
FUNCTION_WORDS = {
    "eng": ["a", "an", "the", "of", "to", "in", "on", "at", "by", "for", "with", "from", "and", "or", "but", "if", "so", "this", "that", "i", "you", "he", "she", "it", "we", "they", "me", "him", "us", "them", "who"],
    "fra": ["le", "la", "les", "un", "une", "des", "de", "du", "au", "aux", "en", "sur", "avec", "et", "ou", "mais", "si", "ce", "je", "tu", "il", "elle", "nous", "vous", "que", "qui"],
    "deu": ["der", "die", "das", "den", "dem", "des", "ein", "eine", "und", "oder", "aber", "ich", "du", "er", "sie", "es", "wir", "in", "auf", "an", "von", "mit", "zu"],
    "spa": ["el", "la", "los", "las", "un", "una", "de", "a", "en", "por", "para", "con", "y", "o", "pero", "si", "yo", "que", "como"],
}
UD_TO_CHAT_POS = {"NOUN": "noun", "VERB": "verb", "AUX": "aux", "ADJ": "adj", "ADV": "adv", "PRON": "pron", "PROPN": "propn", "DET": "det", "ADP": "adp", "CCONJ": "cconj", "SCONJ": "sconj", "NUM": "num", "PART": "part", "INTJ": "intj", "PUNCT": "punct", "SYM": "sym", "X": "x"}
POS_HINTS = {"n": "NOUN", "v": "VERB", "adj": "ADJ", "adv": "ADV", "pro": "PRON", "det": "DET", "prep": "ADP", "conj": "CCONJ", "n:prop": "PROPN", "co": "INTJ", "num": "NUM", "aux": "AUX"}
POS_TO_RELATION = {"NOUN": "OBJ", "VERB": "ROOT", "ADJ": "AMOD", "ADV": "ADVMOD", "PRON": "NSUBJ", "DET": "DET", "ADP": "CASE", "CCONJ": "CC", "INTJ": "DISCOURSE", "NUM": "NUMMOD", "PROPN": "NSUBJ", "AUX": "AUX", "PART": "MARK"}
RELATION_TO_POS = {"DET": "DET", "AMOD": "ADJ", "ADVMOD": "ADV", "CASE": "ADP", "CC": "CCONJ", "AUX": "AUX", "NUMMOD": "NUM", "NSUBJ": "NOUN", "OBJ": "NOUN"}
