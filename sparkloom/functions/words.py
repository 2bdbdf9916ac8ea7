"""Words of many languages: normal form, runs of letters and digits, function words by language.

Text is brought into NFKC first, in Arrow, but only where a text has characters that this could change. Then everything is
built-in expressions. Runs of Han and kana are words of their own, which operators/segmentation.py cuts further.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import composed_text
from .text import STOPWORDS, script_language

#: Ranges of Han, Hiragana and Katakana.
HAN, HIRAGANA, KATAKANA = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}", r"\x{3040}-\x{309F}", r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}"
CJK = HAN + HIRAGANA + KATAKANA
WORD = rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"
#: Texts of Latin, Greek and Cyrillic letters and common marks hold no Han or kana: their words are found by a shorter pattern.
PLAIN, PLAIN_WORD = r"\A[\x00-\x{52F}\x{2010}-\x{2027}\x{20AC}]*\z", r"[\p{L}\p{N}]+"
#: Characters that NFKC leaves as they are, and that do not join one another: ASCII, most of Latin-1, Cyrillic, common marks,
#: Han, kana without sound marks.
SETTLED = r"[\x00-\x7F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\xFF\x{410}-\x{44F}\x{2013}\x{2014}\x{2018}-\x{201E}\x{3001}\x{3002}\x{4E00}-\x{9FFF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}]*"

#: Function words of each language that has a list, in lower case. English has those of text.STOPWORDS too.
FUNCTION_WORDS = {
    "en": """almost also although always among another anyone anything around came done either else enough etc even ever every
        everyone everything get got hence however indeed instead may maybe mine moreover mostly much neither never nevertheless
        nothing often onto others otherwise ought per perhaps rather shall since someone something still thence therefore thing
        things though thus together toward towards unless unto upon us use used using via well whatever whenever whereas wherever
        whether whoever whose within without yet""",
    "es": """a al algo algunas algunos ante antes como con contra cual cuando de del desde donde dos e el ella ellas ellos en entre
        era erais eran eras eres es esa esas ese eso esos esta estaba estado estan estas este esto estos ha habia han hasta hay la
        las le les lo los mas me mi mis mucho muy nada ni no nos nosotros o os otra otras otro otros para pero poco por porque que
        quien se sea segun ser si sin sobre son su sus también tanto te tiene tienen todo todos tu tus un una uno unos vosotros y
        ya yo""",
    "fr": """a au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me meme mes moi mon ne nos
        notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous y d l n s c j être
        avoir plus cette ceux dont""",
    "de": """aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dein deine dem den der des dessen dich die
        dies diese dieser dieses doch dort du durch ein eine einem einen einer eines er es euch euer für hat hatte hier hin ich ihr
        ihre im in ist ja jede jedem jeden jeder kann kein keine mein meine mit nach nicht noch nun nur ob oder ohne sein seine
        sich sie sind so soll über um und uns unser vom von vor war waren was weil weiter wenn wer werden wie wieder will wir wird
        wo zu zum zur""",
    "ru": """а без бы был была были было быть в вам вас весь во вот все всего всех вы где да для до его ее если есть еще же за здесь
        и из им их к как кто ко когда которое которой которые который которых какая какие каких каким какое какой какую ли либо
        мне может мои мой мы на над надо наш не него нее нет ни них но ну о об однако он она они оно от очень по под при с со так
        также такая такие такое такой там те тем то того тоже той только том тот ту ты у уже что чтобы чье чья эта эти это я""",
    "zh": """的 了 和 是 就 都 而 及 与 这 那 你 我 他 她 它 们 在 有 个 上 下 不 也 很 到 说 要 会 着 没有 什么 怎么 为什么 呢 吗 吧 啊
        把 被 给 从 对 于 之 其 或 但 如果 因为 所以 一个 可以 已经 还是 以及 以""",
    "ja": """の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう
        また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において ば なかっ なく
        しかし について だっ たり ます です され でし しょ ょう うか のか ので には にお ける てい であ そし して では でも いう うこ
        とが がで きる れて てき きた たら らな なけ ければ ばな らない""",
}


def stopwords() -> dict[str, list[str]]:
    """Function words by language."""
    return {lang: sorted({*words.split(), *(STOPWORDS if lang == "en" else ())}) for lang, words in FUNCTION_WORDS.items()}


def normal(c: Column) -> Column:
    """NFKC without white space at the ends; null stays. Settled texts do not go through Python."""
    settled = c.rlike(rf"\A{SETTLED}\z")
    return F.trim(F.regexp_replace(F.when(settled, c).otherwise(F.coalesce(composed_text(F.when(~settled, c)), c)), r"\A\s+|\s+\z", ""))


def language_of(text: Column, lang: Column) -> Column:
    """The language as given, its first subtag in lower case; by script where none is."""
    own = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when((own != "") & (own != "und"), own).otherwise(script_language(F.coalesce(text, F.lit(""))))


def surface(c: Column) -> Column:
    """Runs of Han and kana, and runs of other letters and digits, in order and in their own case."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(PLAIN), F.regexp_extract_all(text, F.lit(PLAIN_WORD), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def folded(word: Column) -> Column:
    """Lower case that tells no sharp s and no final sigma from other spellings."""
    return F.translate(F.replace(F.lower(word), F.lit("ß"), F.lit("ss")), "ς", "σ")


def _upper(word: Column) -> Column:
    return (word == F.upper(word)) & (F.upper(word) != F.lower(word))


def loud(words: Column) -> Column:
    """Whether words are mostly in capitals: four words with letters or more, of which four fifths are in capitals."""
    n = F.size(F.filter(words, _upper))
    return F.coalesce(F.when(n >= 4, n >= 0.8 * F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))), F.lit(False))


def stays(word: Column, fold: Column, lang: Column, loud: Column, least: int = 1) -> Column:
    """Whether a word, folded to `fold`, is content in a text of the language."""
    stop = F.lit(False)
    for name, listed in stopwords().items():
        stop = stop | ((lang == name) & fold.isin(*listed))
    capitals = _upper(word) & (F.length(F.regexp_replace(word, r"[^\p{L}]", "")) >= 2) & ~loud
    return (F.length(fold) >= least) & (~stop | capitals)


def content(words: Column, lang: Column, least: int = 1) -> Column:
    """The words folded, without function words of the language and words of fewer than `least` characters.

    A word of two letters or more, all capitals, is no function word, unless the words are mostly in capitals: four words
    with letters or more, of which four fifths are in capitals.
    """
    # what holds for a whole text is bound once, and a word is folded once
    pairs = F.transform(words, lambda w: F.struct(w.alias("w"), folded(w).alias("f")))
    row = F.array(F.struct(pairs.alias("words"), loud(words).alias("loud"), F.coalesce(lang, F.lit("")).alias("lang")))
    return F.element_at(F.transform(row, lambda r: F.transform(F.filter(r["words"], lambda w: stays(w["w"], w["f"], r["lang"], r["loud"], least)), lambda w: w["f"])), 1)


def pieces(run: Column) -> Column:
    """A run of Han and kana without a dictionary: overlapping pairs of Han and of Hiragana, Katakana whole."""
    classes = F.regexp_extract_all(run, F.lit(rf"[{HAN}]+|[{HIRAGANA}]+|[{KATAKANA}]+"), F.lit(0))
    pairs = lambda r: F.when((F.length(r) < 2) | r.rlike(rf"^[{KATAKANA}]"), F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    return F.flatten(F.transform(classes, pairs))
