"""Stemming by rules, word by word.

A language is a list of assignments: each gives a name an expression over the names so far, of which `w` is the word as it
is and p1, p2 and pv are the characters before the regions in which endings may go. The expressions use only what SQL and, but
for spelling, Python have, so that one list runs in Arrow functions (stemmed, stem_table) and as a query elsewhere (as_sql).

The rules are those of the published Snowball stemmers for English, German, Spanish and French; words have no apostrophes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]


def _text(value: str) -> str:
    return f"'{value}'"


def _case(*branches: tuple[str, str], other: str = "w") -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in branches) + f" ELSE {other} END"


def _ends(endings: str | Sequence[str], within: str | None = None) -> str:
    """The longest of the endings that the word, or its part after `within` characters, has."""
    of = f"substr(w, {within} + 1)" if within else "w"
    return f"regexp_extract({of}, '({'|'.join(endings.split() if isinstance(endings, str) else endings)})$', 1)"


def _has(pattern: str, of: str = "w") -> str:
    return f"regexp_extract({of}, '{pattern}', 0) <> ''"


def _is(endings: str, name: str = "e") -> str:
    return f"{name} IN ({', '.join(map(_text, endings.split()))})"


def _in(region: str, name: str = "e") -> str:
    return f"length(w) - length({name}) >= {region}"


def _cut(name: str = "e", put: str = "") -> str:
    cut = f"left(w, length(w) - length({name}))"
    return f"{cut} || '{put}'" if put else cut


def _before(name: str = "e") -> str:
    return f"left(w, length(w) - length({name}))"


def _regions(vowels: str) -> Rules:
    """p1: characters up to the first consonant after a vowel; p2: the same once more, in the rest."""
    after = f"^.*?[{vowels}][^{vowels}]"
    found = lambda of: f"length(regexp_extract({of}, '{after}', 0))"
    return [
        ("p1", f"CASE WHEN {found('w')} > 0 THEN {found('w')} ELSE length(w) END"),
        ("p2", f"CASE WHEN {found('substr(w, p1 + 1)')} > 0 THEN p1 + {found('substr(w, p1 + 1)')} ELSE length(w) END"),
    ]


# ---- English
_EV = "aeiouy"
_SHORT = f"(^[{_EV}][^{_EV}]|[^{_EV}][{_EV}][^{_EV}wxY])$"
#: Words with stems of their own, and words that stay.
_EN_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_EN_STAY = "sky news howe atlas cosmos bias andes"
_EN_LATE = "inning outing canning herring earring proceed exceed succeed"
#: Endings in p1 and what replaces them.
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize"


def _english() -> Rules:
    swap = lambda table, region: [(f"e = '{e}'", _case((_in(region), _cut(put=put)))) for e, put in table.items()]
    special = _case(*((f"word = '{w}'", _text(s)) for w, s in _EN_WORDS.items()), (f"length(word) <= 2 OR {_is(_EN_STAY, 'word')}", "word"), other="NULL")
    vowel_before = _has(f"[{_EV}]", _before())
    return [
        ("w", f"regexp_replace(regexp_replace(word, '^y', 'Y'{{g}}), '([{_EV}])y', '{{1}}Y'{{g}})"),
        *_regions(_EV),
        ("p0", "length(regexp_extract(w, '^(gener|commun|arsen)', 0))"),
        ("p2", f"CASE WHEN p0 = 0 THEN p2 WHEN {_has(f'^.*?[{_EV}][^{_EV}]', 'substr(w, p0 + 1)')} THEN p0 + length(regexp_extract(substr(w, p0 + 1), '^.*?[{_EV}][^{_EV}]', 0)) ELSE length(w) END"),
        ("p1", "CASE WHEN p0 > 0 THEN p0 ELSE p1 END"),
        ("e", _ends("sses ied ies us ss s")),
        ("w", _case(("e = 'sses'", _cut(put="ss")), (_is("ied ies"), f"CASE WHEN length(w) > 4 THEN {_cut(put='i')} ELSE {_cut(put='ie')} END"), (f"e = 's' AND {_has(f'[{_EV}].+s$')}", _cut()))),
        ("late", f"{_is(_EN_LATE, 'w')}"),
        ("held", "w"),
        ("e", _ends("eed eedly ed edly ing ingly")),
        ("gone", f"{_is('ed edly ing ingly')} AND {vowel_before}"),
        ("w", _case((f"{_is('eed eedly')} AND {_in('p1')}", _cut(put="ee")), ("gone", _cut()))),
        ("w", _case((f"gone AND {_has('(at|bl|iz)$')}", "w || 'e'"), (f"gone AND {_has('(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')}", "left(w, length(w) - 1)"), (f"gone AND length(w) <= p1 AND {_has(_SHORT)}", "w || 'e'"))),
        ("w", _case((_has(f".[^{_EV}][yY]$"), "left(w, length(w) - 1) || 'i'"))),
        ("e", _ends([*_EN_2, "ogi", "li"])),
        ("w", _case(*swap(_EN_2, "p1"), (f"e = 'ogi' AND {_in('p1')} AND {_has('l$', _before())}", _cut(put="og")), (f"e = 'li' AND {_in('p1')} AND {_has('[cdeghkmnrt]$', _before())}", _cut()))),
        ("e", _ends([*_EN_3, "ative"])),
        ("w", _case(*swap(_EN_3, "p1"), (f"e = 'ative' AND {_in('p1')} AND {_in('p2')}", _cut()))),
        ("e", _ends(f"{_EN_4} ion")),
        ("w", _case((f"{_is(_EN_4)} AND {_in('p2')}", _cut()), (f"e = 'ion' AND {_in('p2')} AND {_has('[st]$', _before())}", _cut()))),
        ("e", _ends("e l")),
        ("w", _case((f"e = 'e' AND ({_in('p2')} OR ({_in('p1')} AND NOT ({_has(_SHORT, _before())})))", _cut()), (f"e = 'l' AND {_in('p2')} AND {_has('l$', _before())}", _cut()))),
        ("w", f"CASE WHEN late THEN held ELSE w END"),
        ("stem", f"coalesce({special}, replace(w, 'Y', 'y'))"),
    ]


# ---- German
_DV = "aeiouyäöü"


def _german() -> Rules:
    return [
        ("w", "replace(word, 'ß', 'ss')"),
        ("w", f"regexp_replace(w, '([{_DV}])u([{_DV}])', '{{1}}U{{2}}'{{g}})"),
        ("w", f"regexp_replace(w, '([{_DV}])y([{_DV}])', '{{1}}Y{{2}}'{{g}})"),
        *_regions(_DV),
        ("p1", "greatest(p1, 3)"),
        ("e", _ends("em ern er e en es s")),
        ("gone", f"{_is('e en es')} AND {_in('p1')}"),
        ("w", _case((f"{_is('em ern er e en es')} AND {_in('p1')}", _cut()), (f"e = 's' AND {_in('p1')} AND {_has('[bdfghklmnrt]$', _before())}", _cut()))),
        ("w", _case((f"gone AND {_has('niss$')}", "left(w, length(w) - 1)"))),
        ("e", _ends("en er est st")),
        ("w", _case((f"{_is('en er est')} AND {_in('p1')}", _cut()), (f"e = 'st' AND {_in('p1')} AND {_has('...[bdfghklmnt]$', _before())}", _cut()))),
        ("e", _ends("end ung ig ik isch lich heit keit")),
        ("went", f"CASE WHEN {_in('p2')} AND ({_is('end ung lich heit keit')} OR ({_is('ig ik isch')} AND NOT ({_has('e$', _before())}))) THEN e ELSE '' END"),
        ("w", f"CASE WHEN went <> '' THEN {_cut('went')} ELSE w END"),
        ("e", _case((_is("end ung", "went"), _ends("ig")), (_is("lich heit", "went"), _ends("er en")), ("went = 'keit'", _ends("lich ig")), other="''")),
        ("w", _case((f"e = 'ig' AND went <> 'keit' AND {_in('p2')} AND NOT ({_has('e$', _before())})", _cut()), (f"{_is('er en')} AND {_in('p1')}", _cut()), (f"went = 'keit' AND e <> '' AND {_in('p2')}", _cut()))),
        ("stem", "translate(w, 'UYäöü', 'uyaou')"),
    ]


# ---- Spanish
_SV = "aeiouáéíóúü"
#: Endings of step 1 by what happens to them, and of verbs.
_ES_R2 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
_ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias"
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
_ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
_ES_GU = "en es éis emos"
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos"


def _spanish_pv(vowels: str) -> str:
    """Characters before the region of verbs, which depends on the first letters' kinds."""
    v, c = f"[{vowels}]", f"[^{vowels}]"
    part = lambda p: f"regexp_extract(w, '{p}', 0)"
    return _case((f"{part(f'^.{c}.*?{v}')} <> ''", f"length({part(f'^.{c}.*?{v}')})"), (_has(f"^.{c}"), "length(w)"), (f"{part(f'^{v}{v}.*?{c}')} <> ''", f"length({part(f'^{v}{v}.*?{c}')})"), (_has(f"^{v}{v}"), "length(w)"), ("length(w) >= 3", "3"), other="length(w)")


def _spanish() -> Rules:
    plain = "translate(w, 'áéíóú', 'aeiou')"
    return [
        ("w", "word"),
        *_regions(_SV),
        ("pv", _spanish_pv(_SV)),
        ("e", _ends(_ES_PRONOUNS, "pv")),
        ("f", f"regexp_extract(substr({_before()}, pv + 1), '(iéndo|ándo|ár|ér|ír|ando|iendo|ar|er|ir|yendo)$', 1)"),
        ("w", _case((f"e <> '' AND {_is('iéndo ándo ár ér ír', 'f')}", f"left(w, length(w) - length(e) - length(f)) || translate(f, 'áéí', 'aei')"), (f"e <> '' AND ({_is('ando iendo ar er ir', 'f')} OR (f = 'yendo' AND {_has('uyendo$', _before())}))", _cut()))),
        ("start", "w"),
        ("e", _ends(f"{_ES_R2} {_ES_IC} logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos")),
        ("went", f"CASE WHEN (e = 'amente' AND {_in('p1')}) OR (e <> 'amente' AND {_in('p2')}) THEN e ELSE '' END"),
        ("w", _case(("went = ''", "w"), (_is("logía logías", "went"), _cut(put="log")), (_is("ución uciones", "went"), _cut(put="u")), (_is("encia encias", "went"), _cut(put="ente")), other=_cut())),
        ("e", _case((_is(_ES_IC, "went"), _ends("ic")), ("went = 'amente'", _ends("iv os ic ad")), ("went = 'mente'", _ends("ante able ible")), (_is("idad idades", "went"), _ends("abil ic iv")), (_is("iva ivo ivas ivos", "went"), _ends("at")), other="''")),
        ("again", f"went = 'amente' AND e = 'iv' AND {_in('p2')}"),
        ("w", _case((f"e <> '' AND {_in('p2')}", _cut()))),
        ("e", "CASE WHEN again THEN " + _ends("at") + " ELSE '' END"),
        ("w", _case((f"e <> '' AND {_in('p2')}", _cut()))),
        ("done", "went <> ''"),
        ("e", _ends(_ES_Y, "pv")),
        ("went", f"CASE WHEN NOT done AND e <> '' AND {_has('u$', _before())} THEN e ELSE '' END"),
        ("w", f"CASE WHEN went <> '' THEN {_cut()} ELSE w END"),
        ("done", "done OR went <> ''"),
        ("e", f"CASE WHEN done THEN '' ELSE {_ends(f'{_ES_VERB} {_ES_GU}', 'pv')} END"),
        ("w", _case((f"{_is(_ES_GU)} AND {_has('gu$', _before())}", "left(w, length(w) - length(e) - 1)"), ("e <> ''", _cut()))),
        ("e", _ends("os a o á í ó e é", "pv")),
        ("w", _case((f"{_is('e é')} AND {_has('gu$', _before())} AND length(w) - 2 >= pv", "left(w, length(w) - 2)"), ("e <> ''", _cut()))),
        ("stem", plain),
    ]


# ---- French
_FV = "aeiouyâàëéêèïîôûù"
#: Endings of step 1 by what happens to them, and of verbs.
_FR_R2 = "ance iqUe isme able iste eux ances iqUes ismes ables istes"
_FR_IC = "atrice ateur ation atrices ateurs ations"
_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


def _french() -> Rules:
    v, c = f"[{_FV}]", f"[^{_FV}]"
    before = lambda p: f"regexp_extract({_before()}, '({p})$', 1)"
    # what an ending leaves behind goes too, or changes; f is it, g what is before it
    shorter = "left(w, length(w) - length(e) - length(f))"
    f_in = lambda region: f"length(w) - length(e) - length(f) >= {region}"
    return [
        ("w", f"regexp_replace(word, 'qu', 'qU'{{g}})"),
        ("w", f"regexp_replace(w, '({v})u({v})', '{{1}}U{{2}}'{{g}})"),
        ("w", f"regexp_replace(w, '({v})i({v})', '{{1}}I{{2}}'{{g}})"),
        ("w", f"regexp_replace(regexp_replace(w, '({v})y', '{{1}}Y'{{g}}), 'y({v})', 'Y{{1}}'{{g}})"),
        *_regions(_FV),
        ("pv", _case((_has(f"^{v}{v}."), "3"), (_has("^(par|col|tap)"), "3"), (_has(f"^.{c}*?{v}"), f"length(regexp_extract(w, '^.{c}*?{v}', 0))"), other="length(w)")),
        ("start", "w"),
        ("e", _ends(f"{_FR_R2} {_FR_IC} logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments")),
        ("f", _case((_is(_FR_IC), before("ic")), (_is("ement ements"), before("ativ|iv|eus|abl|iqU|ièr|Ièr")), (_is("ité ités"), before("abil|ic|iv")), (_is("if ive ifs ives"), before("icat|at")), other="''")),
        ("w", _case(
            (f"{_is(_FR_R2)} AND {_in('p2')}", _cut()),
            (f"{_is(_FR_IC)} AND {_in('p2')}", f"CASE WHEN f = '' THEN {_cut()} WHEN {f_in('p2')} THEN {shorter} ELSE {shorter} || 'iqU' END"),
            (f"{_is('logie logies')} AND {_in('p2')}", _cut(put="log")),
            (f"{_is('usion ution usions utions')} AND {_in('p2')}", _cut(put="u")),
            (f"{_is('ence ences')} AND {_in('p2')}", _cut(put="ent")),
            (f"{_is('ement ements')} AND {_in('pv')}", _case(
                (f"f = 'ativ' AND {f_in('p2')}", shorter), (f"f = 'ativ' AND length(w) - length(e) - 2 >= p2", "left(w, length(w) - length(e) - 2)"), (f"{_is('iv abl iqU', 'f')} AND {f_in('p2')}", shorter),
                (f"f = 'eus' AND {f_in('p2')}", shorter), (f"f = 'eus' AND {f_in('p1')}", f"{shorter} || 'eux'"), (f"{_is('ièr Ièr', 'f')} AND {f_in('pv')}", f"{shorter} || 'i'"), other=_cut())),
            (f"{_is('ité ités')} AND {_in('p2')}", _case((f"f <> '' AND {f_in('p2')}", shorter), ("f = 'abil'", f"{shorter} || 'abl'"), ("f = 'ic'", f"{shorter} || 'iqU'"), other=_cut())),
            (f"{_is('if ive ifs ives')} AND {_in('p2')}", _case((f"f = 'icat' AND {f_in('p2')}", shorter), (f"f = 'icat' AND length(w) - length(e) - 2 >= p2", f"{shorter} || 'iqU'"), (f"f = 'at' AND {f_in('p2')}", shorter), other=_cut())),
            ("e = 'eaux'", _cut(put="eau")),
            (f"e = 'aux' AND {_in('p1')}", _cut(put="al")),
            (f"{_is('euse euses')} AND {_in('p2')}", _cut()), (f"{_is('euse euses')} AND {_in('p1')}", _cut(put="eux")),
            (f"{_is('issement issements')} AND {_in('p1')} AND {_has(f'{c}$', _before())}", _cut()),
            (f"e = 'amment' AND {_in('pv')}", _cut(put="ant")),
            (f"e = 'emment' AND {_in('pv')}", _cut(put="ent")),
            (f"{_is('ment ments')} AND {_has(f'{v}$', f'substr({_before()}, pv + 1)')}", _cut()),
        )),
        ("went", f"w <> start"),
        ("verb", f"NOT went OR {_is('amment emment ment ments')}"),
        ("e", f"CASE WHEN verb THEN {_ends(_FR_I, 'pv')} ELSE '' END"),
        ("gone", f"e <> '' AND {_has(f'{c}$', f'substr({_before()}, pv + 1)')}"),
        ("w", f"CASE WHEN gone THEN {_cut()} ELSE w END"),
        ("e", f"CASE WHEN verb AND NOT gone THEN {_ends(f'ions {_FR_E} {_FR_A}', 'pv')} ELSE '' END"),
        ("held", "w"),
        ("w", _case((f"e = 'ions' AND {_in('p2')}", _cut()), (_is(_FR_E), _cut()), (f"{_is(_FR_A)} AND {_has('e$', f'substr({_before()}, pv + 1)')}", "left(w, length(w) - length(e) - 1)"), (_is(_FR_A), _cut()))),
        ("went", "went OR gone OR w <> held"),
        ("w", _case((f"went AND {_has('Y$')}", "left(w, length(w) - 1) || 'i'"), (f"went AND {_has('ç$')}", "left(w, length(w) - 1) || 'c'"), (f"NOT went AND {_has('[^aiouès]s$')}", "left(w, length(w) - 1)"))),
        ("e", f"CASE WHEN went THEN '' ELSE {_ends('ion ier ière Ier Ière e ë', 'pv')} END"),
        ("w", _case((f"e = 'ion' AND {_in('p2')} AND {_has('[st]$', f'substr({_before()}, pv + 1)')}", _cut()), (_is("ier ière Ier Ière"), _cut(put="i")), ("e = 'e'", _cut()), (f"e = 'ë' AND {_has('gu$', _before())}", _cut()))),
        ("w", _case((_has("(enn|onn|ett|ell|eill)$"), "left(w, length(w) - 1)"))),
        ("w", f"regexp_replace(w, '[éè]({c}+)$', 'e{{1}}'{{g}})"),
        ("stem", "translate(w, 'IUY', 'iuy')"),
    ]


STEMMERS = {"en": _english, "de": _german, "es": _spanish, "fr": _french}


#: Words of a language whose stems a task remembers, and the longest such word.
REMEMBERED, LONGEST = 300_000, 40
#: How Python spells what is outside the quotes. A case is a list of one value, which is true whatever the value.
_PYTHON = [("CASE WHEN ", "(("), (" THEN ", ") and ["), (" WHEN ", "] or ("), (" ELSE ", "] or ["), (" END", "])[0]"), (" AND ", " and "), (" OR ", " or "), ("NOT ", "not "), (" <> ", " != "), (" = ", " == "), (" || ", " + "), ("NULL", "None"), (" IN (", " in (")]


def _filled(expression: str, dialect: str) -> str:
    for key, value in (("{g}", ", 'g'" if dialect == "sql" else ""), ("{1}", "\\1"), ("{2}", "\\2")):
        expression = expression.replace(key, value)
    return expression


def _in_python(expression: str) -> str:
    parts = _filled(expression, "python").split("'")  # every second one is a literal
    for i, part in enumerate(parts):
        if i % 2:
            parts[i] = repr(part)
            continue
        for key, value in _PYTHON:
            part = part.replace(key, value)
        parts[i] = part
    # a list of one word is no string
    return re.sub(r" in \(('[^']*')\)", r" in (\1,)", "".join(parts))


@cache
def _pattern(of: str) -> re.Pattern:
    return re.compile(of)


def _extracted(text: str, pattern: str, group: int) -> str:
    found = _pattern(pattern).search(text)
    return found[group] or "" if found else ""


#: The functions of the rules; places in a text count from 1.
_FUNCTIONS = {
    "length": len, "left": lambda text, n: text[: max(n, 0)], "substr": lambda text, at: text[at - 1 :], "greatest": max,
    "coalesce": lambda first, other: other if first is None else first, "replace": lambda text, of, put: text.replace(of, put),
    "translate": lambda text, of, put: text.translate(str.maketrans(of, put)), "regexp_extract": _extracted, "regexp_replace": lambda text, pattern, put: _pattern(pattern).sub(put, text),
}


@cache
def stemmer(lang: str | None) -> Callable[[str], str] | None:
    """The rules of a language as a function of a word in lower case; none for a language without rules."""
    if lang not in STEMMERS:
        return None
    lines = [f"    {name} = {_in_python(expression)}" for name, expression in STEMMERS[lang]()]
    made: dict = {}
    exec("\n".join(["def stem_of(word):", *lines, "    return stem"]), dict(_FUNCTIONS), made)  # noqa: S102
    return made["stem_of"]


def _stems() -> Callable[[pa.Array, pa.Array, np.ndarray], pa.Array]:
    """A function of words, a dictionary of languages and each word's place there, which works on each distinct pair of a word and a language once."""
    known: dict[str, dict[str, str]] = {}

    def stem(lang: str | None, word: str | None) -> str | None:
        own = stemmer(lang)
        if own is None or word is None:
            return word
        seen = known.setdefault(lang, {})
        found = seen.get(word)
        if found is None:
            found = own(word)
            if len(seen) >= REMEMBERED:
                seen.clear()
            if len(word) <= LONGEST:
                seen[word] = found
        return found

    def run(words: pa.Array, langs: pa.Array, of: np.ndarray) -> pa.Array:
        coded = words.dictionary_encode(null_encoding="encode")
        listed, names = coded.dictionary.to_pylist(), langs.to_pylist()
        pairs, at = np.unique(of * max(1, len(listed)) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        made = [stem(names[p // len(listed)], listed[p % len(listed)]) for p in pairs.tolist()]
        return pa.array(made, pa.string()).take(pa.array(at))

    return run


def _languages(langs: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = langs.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def stemmed(tokens: Column, lang: Column) -> Column:
    """The stem of each word of an array, in its row, by the rules of the row's language; words of other languages stay. The
    words are in lower case; a null array stays null."""
    stems = _stems()

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array, langs: pa.Array) -> pa.Array:
        names, of = _languages(langs)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = stems(lists.flatten(), names, np.repeat(of, sizes))
        # a null among the borders makes a null list
        ends = np.cumsum(np.r_[0, sizes])
        borders = pa.array(ends, pa.int32(), mask=np.r_[lists.is_null().to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(borders, flat)

    return run(tokens, lang)


def stem_table(words: DataFrame, lang: str = "lang", word: str = "term") -> DataFrame:
    """`words` with stem: that of its word by the rules of its language; words of other languages, and null ones, stay. The
    words are in lower case, and distinct ones, so that each is worked on once."""
    stems = _stems()

    @F.arrow_udf("string")
    def run(own: pa.Array, langs: pa.Array) -> pa.Array:
        names, of = _languages(langs)
        return stems(own, names, of)

    return words.select(*words.columns, run(F.col(word), F.col(lang)).alias("stem"))


def as_sql(source: str, lang: str = "lang", word: str = "term") -> str:
    """A query in the shared dialect for (lang, term, stem) over `source`, a table or a query in brackets."""
    parts = [f"SELECT {lang}, {word}, {word} AS stem FROM {source} WHERE {lang} IS NULL OR {lang} NOT IN ({', '.join(map(_text, STEMMERS))})"]
    for name, rules in STEMMERS.items():
        inner, known = f"(SELECT {lang}, {word}, {word} AS word FROM {source} WHERE {lang} = '{name}')", {"word"}
        for column, expression in rules():
            value = _filled(expression, "sql")
            inner = f"(SELECT * {f'REPLACE ({value} AS {column})' if column in known else f', {value} AS {column}'} FROM {inner})"
            known.add(column)
        parts.append(f"SELECT {lang}, {word}, stem FROM {inner}")
    return " UNION ALL ".join(parts)
