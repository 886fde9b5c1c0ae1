"""Text functions against results worked out by hand, with nulls, empty and odd texts."""

from pyspark.sql import functions as F

from foliomark.functions import language as lang
from foliomark.functions import text as tx


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


def test_clean_text(spark):
    assert one(spark, tx.clean_text, " a\r\nb\rc\x07\n\n\n\nd  \t e ") == "a\nb\nc\n\nd e"
    assert one(spark, tx.clean_text, "") == ""
    assert one(spark, tx.clean_text, None) is None


def test_tokens_and_grams(spark):
    assert one(spark, tx.tokens, "Élan, x_1 हिन्दी!") == ["élan", "x_1", "ह", "न", "द"]
    assert one(spark, lambda c: tx.grams(tx.tokens(c), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: tx.grams(tx.tokens(c), 5), "a b c") == []
    assert one(spark, lambda c: tx.grams(tx.tokens(c), 2), None) == []


def test_sentences(spark):
    assert one(spark, tx.sentences, "Dr. Who came. He left! no cap. Yes?") == ["Dr. Who came.", "He left! no cap.", "Yes?"]
    assert one(spark, tx.sentences, "") == []


def test_paragraphs(spark):
    long = "x" * 45
    got = one(spark, tx.paragraphs, f"{long}\n\naa bb cc dd ee ff gg\n\nhh ii jj kk ll mm nn oo\n\n{long}")
    assert got == [long, "aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo", long]
    assert one(spark, tx.paragraphs, "") == []


def test_heading(spark):
    for text, expected in (("1. Introduction", True), ("Introduction", True), ("RELATED WORK", True), ("The Main Result", True), ("This is a sentence.", False), ("lower case words here", False), ("", False), (None, False), ("x " * 20, False)):
        assert one(spark, tx.is_heading, text) is expected, text


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(370))
    got = one(spark, tx.chunks, words)
    assert [len(c.split()) for c in got] == [200, 200, 50]
    assert got[1].split()[0] == "w160"
    assert one(spark, tx.chunks, "") == []


def test_html_and_domain(spark):
    assert one(spark, tx.html_text, "<p>A &lt;b&gt;</p><script>x<y</script><nav>n</nav> c") == "A <b> c"
    assert one(spark, tx.domain, "https://u@h.example:81/p?q") == "u@h.example:81"
    assert one(spark, tx.syllables, "create") == 1 and one(spark, tx.syllables, "banana") == 3


def test_language(spark):
    for text, expected in (("the cat is in the house", "en"), ("le chat est dans la maison", "fr"), ("это кошка", "ru"), ("یہ ایک کتاب ہے", "ur"), ("هذا من على", "ar"), ("这是书", "zh"), ("123", "unknown"), ("", "unknown")):
        assert one(spark, lang.detect_language, text) == expected, text
    assert one(spark, lang.detect_script, None) == "unknown"
    assert one(spark, lang.language_name, "fr") == "French" and one(spark, lang.language_name, "xx") == "xx"
