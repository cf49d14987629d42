"""Rules of languages as rows: conditions on a word, and the analysis that it gets (used by ``operators.cascades``)."""

from __future__ import annotations

# Rules for Japanese words, the first that holds counts. (where, what, class of the word or "", new class, new lemma);
# where: "has" or "is" (the text), "lemma_has" or "lemma_is".
JAPANESE = [
    ("has", "ちゃ", "", "sconj", "ば"), ("has", "なきゃ", "", "sconj", "なきゃ"), ("has", "じゃ", "", "sconj", "ちゃ"), ("has", "れる", "", "aux", "られる"), ("has", "じゃう", "", "aux", "ちゃう"),
    ("has", "よう", "", "aux", "おう"), ("has", "だら", "", "aux", "たら"), ("lemma_has", "だ", "", "aux", "た"), ("is+lemma_has", "さ|為る", "", "part", "為る"), ("lemma_has", "無い", "", "aux", "ない"),
    ("lemma_has", "せる", "", "aux", "させる"), ("has", "撮る", "", "verb", "撮る"), ("has", "貼る", "", "verb", "貼る"), ("has", "混ぜ", "", "verb", "混ぜる"), ("has", "釣る", "", "verb", "釣る"),
    ("has", "速い", "adj", "adj", "速い"), ("has", "治ま", "", "verb", "治まる"), ("has", "刺す", "", "verb", "刺す"), ("has", "降り", "", "verb", "降りる"), ("has", "降", "", "verb", "降る"),
    ("has", "載せ", "", "verb", "載せる"), ("has", "帰", "", "verb", "帰る"), ("has", "はい", "", "intj", "はい"), ("has", "うん", "", "intj", "うん"), ("has", "おっ", "", "intj", "おっ"),
    ("has", "ほら", "", "intj", "ほら"), ("has", "ヤッホー", "", "intj", "ヤッホー"), ("has", "ただいま", "", "intj", "ただいま"), ("has", "あたし", "", "pron", "あたし"), ("has", "舐め", "", "verb", "舐める"),
    ("has", "バツ", "", "noun", "バツ"), ("has", "ブラシ", "", "noun", "ブラシ"), ("has", "引き出し", "", "noun", "引き出し"), ("has", "下さい", "", "noun", "下さい"), ("lemma_is", "シャャミー", "", "noun", "クシャミ"),
    ("lemma_is", "物コャミ", "", "noun", "クシャミ"), ("has", "マヨネーズ", "", "noun", "マヨネーズ"), ("has", "マヨ", "", "noun", "マヨ"), ("has", "チップス", "", "noun", "チップス"), ("has", "ゴロンっ", "", "noun", "ゴロンっ"),
    ("has", "モチーンっ", "", "noun", "モチーンっ"), ("is", "人っ", "", "noun", "人"), ("is", "掻く", "", "part", "かい"), ("has", "遣", "noun", "verb", "遣る"), ("has", "死", "", "verb", "死ぬ"),
    ("has", "立", "", "verb", "立つ"), ("has", "引", "", "verb", "引く"), ("has", "出", "", "verb", "出す"), ("has", "飲", "", "verb", "飲む"), ("has", "呼", "", "verb", "呼ぶ"),
    ("has", "脱", "", "verb", "脱ぐ"), ("is", "な", "part", "aux", "な"), ("is", "呼ん", "", "verb", "呼ぶ"), ("is", "な", "aux", "aux", "な"), ("is", "だり", "", "aux", "たり"),
    ("is", "たり", "", "aux", "たり"), ("is", "たら", "", "sconj", "たら"), ("is", "たっ", "", "sconj", "たっ"), ("is+lemma_is", "なさい|為さる", "", "aux", "為さい"), ("lemma_is", "ちゃ", "", "sconj", "ちゃ"),
    ("lemma_is", "ない", "", "aux", "ない"), ("is", "脱", "noun", "verb", "脱"), ("is", "よう", "aux", "aux", "よう"), ("is+lemma_is", "ろ|為る", "aux", "aux", "ろ"), ("is", "で", "", "sconj", "で"),
]

# Italian words that a parser splits although they are one word: text, class, lemma, features.
ITALIAN_ONE_WORD = [
    ("parla", "VERB", "parlare", "Mood=Ind|Number=Sing|Person=3|Tense=Pres|VerbForm=Fin"), ("arancione", "NOUN", "arancione", "Gender=Masc|Number=Sing"), ("piccolo", "ADJ", "piccolo", "Gender=Masc|Number=Sing"),
    ("gomitolo", "NOUN", "gomitolo", "Gender=Masc|Number=Sing"), ("divano", "NOUN", "divano", "Gender=Masc|Number=Sing"), ("pallone", "NOUN", "pallone", "Gender=Masc|Number=Sing"),
    ("bastone", "NOUN", "bastone", "Gender=Masc|Number=Sing"), ("cappello", "NOUN", "cappello", "Gender=Masc|Number=Sing"), ("difficile", "ADJ", "difficile", "Number=Sing"),
    ("seggiola", "NOUN", "seggiola", "Gender=Fem|Number=Sing"), ("piccola", "ADJ", "piccolo", "Gender=Fem|Number=Sing"), ("trottola", "NOUN", "trottola", "Gender=Fem|Number=Sing"),
    ("bottone", "NOUN", "bottone", "Gender=Masc|Number=Sing"), ("cielo", "NOUN", "cielo", "Gender=Masc|Number=Sing"), ("normale", "ADJ", "normale", "Number=Sing"),
    ("cavallone", "NOUN", "cavallone", "Gender=Masc|Number=Sing"), ("coccole", "NOUN", "coccole", "Gender=Fem|Number=Plur"), ("la", "DET", "il", "Definite=Def|Gender=Fem|Number=Sing|PronType=Art"),
]

# Italian commands with pronouns that a parser takes for adjectives: text, lemma of the verb.
ITALIAN_COMMANDS = [
    ("dammela", "dare"), ("dammelo", "dare"), ("prendilo", "prendere"), ("prendila", "prendere"), ("prendili", "prendere"), ("prendile", "prendere"),
    ("aprila", "aprire"), ("aprili", "aprire"), ("finila", "finire"), ("aprilo", "aprire"), ("leggila", "leggere"),
]
COMMAND_FEATURES = "Mood=Imp|Number=Sing|Person=2|VerbForm=Fin"
# Italian words whose first part is a verb that a parser takes for something else: text, lemma of the verb.
ITALIAN_FIRST_VERB = [("dagliela", "dare"), ("posala", "posare"), ("posalo", "posare")]
