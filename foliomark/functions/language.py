"""Script and language of a text by character ranges and marker words, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, pieces

# Scripts by range of code points, with the language each stands for.
SCRIPTS = {
    "latin": (r"A-Za-z", "en"), "cyrillic": (r"\x{400}-\x{4FF}", "ru"), "arabic": (r"\x{600}-\x{6FF}", "ur"), "hebrew": (r"\x{590}-\x{5FF}", "he"),
    "devanagari": (r"\x{900}-\x{97F}", "hi"), "cjk": (r"\x{4E00}-\x{9FFF}", "zh"), "hiragana": (r"\x{3040}-\x{309F}", "ja"), "katakana": (r"\x{30A0}-\x{30FF}", "ja"),
    "hangul": (r"\x{AC00}-\x{D7AF}", "ko"), "thai": (r"\x{E00}-\x{E7F}", "th"), "bengali": (r"\x{980}-\x{9FF}", "bn"), "tamil": (r"\x{B80}-\x{BFF}", "ta"),
    "telugu": (r"\x{C00}-\x{C7F}", "te"), "gujarati": (r"\x{A80}-\x{AFF}", "gu"), "gurmukhi": (r"\x{A00}-\x{A7F}", "pa"),
}
# Marker words.
ARABIC_SCRIPT = {
    "ur": ("ہے", "کی", "کا", "کو", "میں", "اور", "سے", "نے", "پر", "یہ", "کیا", "نہیں", "ہیں", "تھا", "تھی", "کے", "ایک", "بھی"),
    "ar": ("في", "من", "على", "إلى", "هذا", "هذه", "التي", "الذي", "كان", "هو", "هي", "أن", "لا", "ما", "مع", "عن", "كل"),
    "fa": ("است", "که", "را", "این", "آن", "برای", "با", "از", "می", "شود"),
}
LATIN_SCRIPT = {
    "en": ("the", "is", "and", "of", "to", "in", "a"),
    "fr": ("le", "la", "les", "et", "est", "un", "une"),
    "es": ("el", "la", "los", "y", "es", "un", "una"),
    "de": ("der", "die", "das", "und", "ist", "ein"),
    "it": ("il", "la", "e", "è", "un", "una", "di"),
    "pt": ("o", "a", "os", "e", "é", "um", "uma"),
}
# Names of languages.
NAMES = {
    "en": "English", "ur": "Urdu", "hi": "Hindi", "ar": "Arabic", "fa": "Persian", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "ru": "Russian", "he": "Hebrew", "th": "Thai",
    "bn": "Bengali", "ta": "Tamil", "te": "Telugu", "gu": "Gujarati", "pa": "Punjabi", "fr": "French", "es": "Spanish", "de": "German", "it": "Italian", "pt": "Portuguese",
}


def script_counts(c: Column) -> Column:
    """Letters of each script: an array of (script, letters, place of the first); other letters are ``other``."""
    every = "".join(r for r, _ in SCRIPTS.values())

    def counted(letters: Column) -> Column:
        def entry(name: str, ranges: str) -> Column:
            without = F.regexp_replace(letters, f"[{ranges}]+", "")
            first = F.length(F.regexp_extract(letters, f"^[^{ranges}]*", 0)) if not ranges.startswith("^") else F.length(F.regexp_extract(letters, f"^[{ranges[1:]}]*", 0))
            return F.struct(F.lit(name).alias("script"), (F.length(letters) - F.length(without)).alias("letters"), first.alias("place"))

        return F.array(*(entry(name, ranges) for name, (ranges, _) in SCRIPTS.items()), entry("other", f"^{every}"))

    return bound(F.regexp_replace(c, r"[^\p{L}]+", ""), counted)


def detect_script(c: Column) -> Column:
    """The script of most letters, of equals the one met first; ``unknown`` without letters."""
    ranked = F.array_max(F.transform(script_counts(c), lambda x: F.struct(x["letters"].alias("n"), (-x["place"]).alias("p"), x["script"].alias("s"))))
    return F.when(c.isNull(), F.lit("unknown")).otherwise(bound(ranked, lambda best: F.when(best["n"] == 0, F.lit("unknown")).otherwise(best["s"])))


def _first_best(scores: dict[str, Column], none: str) -> Column:
    ranked = F.array_max(F.array(*(F.struct(score.alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, score) in enumerate(scores.items()))))
    return bound(ranked, lambda best: F.when(best["n"] > 0, best["lang"]).otherwise(F.lit(none)))


def detect_language(c: Column) -> Column:
    """Language code: the script's language, refined by marker words in Arabic and Latin script."""
    def arabic(words: Column) -> Column:
        return _first_best({lang: F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in marks)))) for lang, marks in ARABIC_SCRIPT.items()}, "ur")

    def hits(padded: Column, word: str) -> Column:
        mark = f" {word} "
        return ((F.length(padded) - F.length(F.replace(padded, F.lit(mark), F.lit("")))) / len(mark)).cast("int")

    def latin(padded: Column) -> Column:
        return _first_best({lang: sum((hits(padded, w) for w in marks), F.lit(0)) for lang, marks in LATIN_SCRIPT.items()}, "en")

    direct = F.create_map(*(F.lit(x) for name, (_, lang) in SCRIPTS.items() for x in (name, lang)))

    def of_script(script: Column) -> Column:
        refined = F.when(script == "arabic", bound(F.array_distinct(pieces(c)), arabic)).when(script == "latin", bound(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), latin))
        return refined.otherwise(F.coalesce(direct[script], F.lit("unknown")))

    return bound(detect_script(c), of_script)


def language_name(code: Column) -> Column:
    """English name of a language code, or the code itself."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    return F.coalesce(names[code], code)


def same_language(a: Column, b: Column) -> Column:
    return detect_language(a) == detect_language(b)
