"""Stemming of English and Russian words by the published Porter2 and Snowball algorithms, and the terms of a text."""

from __future__ import annotations

import functools
import re

WORD = re.compile(r"[^\W_]+")

# Stop words.
STOP = {
    "english": set("i me my we our ours you your yours he him his she her hers it its they them their what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()),
    "russian": set("и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между".split()),
}


def _rv_english(w: str) -> tuple[int, int]:
    """Starts of the regions after the first and second vowel-consonant pair."""
    def after(start: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(w, start)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(re.search(r"(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", w))


# Words that English stemming treats by hand, and its ending tables.
WHOLE = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl") | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
DONE = set("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = [x.split(":") for x in "ization:ize ational:ate ousness:ous iveness:ive fulness:ful tional:tion biliti:ble lessli:less entli:ent ation:ate alism:al aliti:al ousli:ous iviti:ive fulli:ful enci:ence anci:ance abli:able izer:ize ator:ate alli:al bli:ble".split()]
STEP3 = [x.split(":") for x in "ational:ate tional:tion alize:al icate:ic iciti:ic ical:ic ful: ness:".split()]
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


@functools.lru_cache(maxsize=100_000)
def english(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = re.sub(r"(?<=[aeiouy])y", "Y", re.sub("^y", "Y", w))
    r1, r2 = _rv_english(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in DONE:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end in ("eedly", "eed"):
                w = base + "ee" if len(base) >= r1 else w
            elif re.search("[aeiouy]", base):
                if base.endswith(("at", "bl", "iz")):
                    w = base + "e"
                elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", base):
                    w = base[:-1]
                else:
                    w = base + "e" if _short(base, min(r1, len(base)) if r1 <= len(base) else r1) else base
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, to in STEP2:
        if w.endswith(end):
            w = w[: -len(end)] + to if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ogi") and w[-4:-3] == "l" and len(w) - 3 >= r1:
            w = w[:-1]
        elif w.endswith("li") and w[-3:-2] in tuple("cdeghkmnrt") and len(w) - 2 >= r1:
            w = w[:-2]
    for end, to in STEP3:
        if w.endswith(end):
            w = w[: -len(end)] + to if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith("ion") and w[-4:-3] in ("s", "t") and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1], len(w)):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# Endings of Russian words, longest first within a class; those marked ' need а or я before them.
def _ends(s: str) -> list[tuple[str, bool]]:
    return sorted(((x.strip("'"), x.endswith("'")) for x in s.split()), key=lambda x: -len(x[0]))


GERUND = _ends("в' вши' вшись' ив ивши ившись ыв ывши ывшись")
ADJECTIVE = _ends("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
PARTICIPLE = _ends("ем' нн' вш' ющ' щ' ивш ывш ующ")
REFLEXIVE = _ends("ся сь")
VERB = _ends("ла' на' ете' йте' ли' й' л' ем' н' ло' но' ет' ют' ны' ть' ешь' нно' ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
NOUN = _ends("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def _cut(w: str, ends: list[tuple[str, bool]], rv: int) -> str | None:
    for e, guarded in ends:
        if w.endswith(e) and len(w) - len(e) >= rv:
            if not guarded:
                return w[: -len(e)]
            if len(w) - len(e) - 1 >= rv and w[-len(e) - 1] in "ая":
                return w[: -len(e)]
    return None


@functools.lru_cache(maxsize=100_000)
def russian(w: str) -> str:
    w = w.replace("ё", "е")
    m = re.search("[аеиоуыэюя]", w)
    if not m:
        return w
    rv = m.end()
    r = re.compile("[аеиоуыэюя][^аеиоуыэюя]")
    r1 = x.end() if (x := r.search(w)) else len(w)
    r2 = x.end() if (x := r.search(w, r1)) else len(w)
    got = _cut(w, GERUND, rv)
    if got is None:
        got = _cut(w, REFLEXIVE, rv)
        w = w if got is None else got
        got = _cut(w, ADJECTIVE, rv)
        if got is not None:
            got = _cut(got, PARTICIPLE, rv) or got
        else:
            got = _cut(w, VERB, rv)
            got = _cut(w, NOUN, rv) if got is None else got
    w = w if got is None else got
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    for e in ("ость", "ост"):
        if w.endswith(e) and len(w) - len(e) >= r2:
            w = w[: -len(e)]
            break
    for e in ("ейше", "ейш"):
        if w.endswith(e) and len(w) - len(e) >= rv:
            w = w[: -len(e)]
            break
    if w.endswith("нн") and len(w) - 1 >= rv:
        return w[:-1]
    return w[:-1] if w.endswith("ь") and len(w) - 1 >= rv else w


def stem(word: str, language: str) -> str | None:
    """The term of a lower-case word, or None for a stop word; in Russian texts Latin words are stemmed as English."""
    if language == "simple":
        return word
    if word in STOP.get(language, ()):
        return None
    if language == "russian" and not word.isascii():
        return russian(word)
    return english(word) if language in ("english", "russian") else word


def terms(text: str, language: str = "simple") -> list[str]:
    return [t for w in WORD.findall(text.lower()) if (t := stem(w, language)) is not None]
