"""Stemming as Column expressions: the published Snowball rules for English, German and Spanish.

A word is lower-case. Each step names what it has so far (with_value) instead of repeating it, so expressions grow with the
number of rules, not with their nesting. Regions are kept as the number of characters before them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_value(value: Column, fn) -> Column:
    """fn(value), with the value computed once."""
    return F.transform(F.array(value), fn)[0]


def ending(word: Column, endings: str) -> Column:
    """The longest of the endings that the word has, or an empty text."""
    return F.regexp_extract(word, f"({endings.replace(' ', '|')})$", 1)


def without(word: Column, n) -> Column:
    """The word less n characters at its end (a number, or the length of a text)."""
    return F.left(word, F.greatest(F.length(word) - (F.length(n) if isinstance(n, Column) else n), F.lit(0)))


def inside(word: Column, end: Column, before: Column) -> Column:
    """Whether an ending, which isn't empty, lies in the region that begins after so many characters."""
    return (end != "") & (F.length(word) - F.length(end) >= before)


def region(word: Column, vowels: str, after: Column | None = None) -> Column:
    """Characters before what follows the first consonant after a vowel; all of them if there is none. after: looks behind so many."""
    start = F.lit(0) if after is None else after
    head = F.regexp_extract(F.substring(word, start + 1, F.length(word)), f"^[^{vowels}]*[{vowels}]+[^{vowels}]", 0)
    return F.when(head == "", F.length(word)).otherwise(start + F.length(head)).cast("int")


def table(pairs: str) -> Column:
    """A map from "ending:replacement" words; nothing after the colon deletes."""
    return F.create_map(*(F.lit(x) for p in pairs.split() for x in p.split(":")))


def swapped(word: Column, end: Column, by: Column) -> Column:
    return F.concat(without(word, end), by)


def chain(word: Column, *steps) -> Column:
    return reduce(with_value, steps, word)


# Fixed values of the English rules.
EN = "aeiouy"
EN_SPECIAL = "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
EN_WHOLE = "inning outing canning herring earring proceed exceed succeed".split()
EN_2 = (
    "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful "
    "ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less ogi:og li:"
)
EN_3 = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:"
EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"
EN_SHORT = rf"(?:[^{EN}][{EN}][^{EN}wxY]|^[{EN}][^{EN}])$"


def english(word: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"([{EN}])y", "$1Y")

    def regions(w):
        special = F.regexp_extract(w, "^(gener|commun|arsen)", 1)
        return with_value(F.when(special != "", F.length(special)).otherwise(region(w, EN)).cast("int"), lambda r1: with_value(F.struct(r1.alias("r1"), region(w, EN, r1).alias("r2")), lambda r: stem(w, r)))

    def plural(w):
        end = ending(w, "sses ied ies us ss s")
        return with_value(end, lambda e: F.when(e == "sses", without(w, 2)).when(e.isin("ied", "ies"), F.when(F.length(w) > 4, without(w, 2)).otherwise(without(w, 1)))
                          .when((e == "s") & without(w, 2).rlike(f"[{EN}]"), without(w, 1)).otherwise(w))

    def past(w, r1):
        def shorter(x):
            return (
                F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))).when(x.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), without(x, 1))
                .when(x.rlike(EN_SHORT) & (F.length(x) <= r1), F.concat(x, F.lit("e"))).otherwise(x)
            )

        def cut(e):
            rest = without(w, e)
            return F.when(e.isin("eed", "eedly"), F.when(inside(w, e, r1), F.concat(rest, F.lit("ee"))).otherwise(w)).when((e != "") & rest.rlike(f"[{EN}]"), with_value(rest, shorter)).otherwise(w)

        return with_value(ending(w, "eedly eed edly ed ingly ing"), cut)

    def replaced(w, pairs, r1, keep):
        names = " ".join(p.split(":")[0] for p in pairs.split())
        return with_value(ending(w, names), lambda e: F.when(inside(w, e, r1) & keep(w, e), swapped(w, e, table(pairs)[e])).otherwise(w))

    def stem(w, r):
        r1, r2 = r["r1"], r["r2"]
        second = lambda x, e: F.when(e == "ogi", without(x, 3).endswith("l")).when(e == "li", without(x, 2).rlike("[cdeghkmnrt]$")).otherwise(True)
        third = lambda x, e: (e != "ative") | inside(x, e, r2)
        fourth = lambda x, e: F.when(inside(x, e, r2) & ((e != "ion") | without(x, 3).rlike("[st]$")), without(x, e)).otherwise(x)
        last = lambda x: (
            F.when(x.endswith("e") & ((F.length(x) - 1 >= r2) | (F.length(x) - 1 >= r1) & ~without(x, 1).rlike(EN_SHORT)), without(x, 1))
            .when(x.endswith("ll") & (F.length(x) - 1 >= r2), without(x, 1)).otherwise(x)
        )
        rest = lambda x: chain(
            past(x, r1), lambda y: F.regexp_replace(y, f"(?<=.[^{EN}])[yY]$", "i"), lambda y: replaced(y, EN_2, r1, second), lambda y: replaced(y, EN_3, r1, third),
            lambda y: with_value(ending(y, EN_4), lambda e: fourth(y, e)), last,
        )
        return with_value(plural(w), lambda x: F.when(x.isin(*EN_WHOLE), x).otherwise(rest(x)))

    stemmed = F.replace(with_value(marked, regions), F.lit("Y"), F.lit("y"))
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(F.try_element_at(table(EN_SPECIAL), word), stemmed))


# Fixed values of the German rules.
DE = "aeiouyäöü"


def german(word: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(F.replace(word, F.lit("ß"), F.lit("ss")), f"(?<=[{DE}])u(?=[{DE}])", "U"), f"(?<=[{DE}])y(?=[{DE}])", "Y")

    def regions(w):
        return with_value(region(w, DE), lambda r1: with_value(F.struct(F.greatest(r1, F.least(F.lit(3), F.length(w))).alias("r1"), region(w, DE, r1).alias("r2")), lambda r: stem(w, r["r1"], r["r2"])))

    def first(w, r1):
        def cut(e):
            rest = without(w, e)
            bare = F.when(e.isin("e", "en", "es") & rest.endswith("niss"), without(rest, 1)).otherwise(rest)
            return F.when(inside(w, e, r1) & ((e != "s") | rest.rlike("[bdfghklmnrt]$")), bare).otherwise(w)

        return with_value(ending(w, "ern em er en es e s"), cut)

    def second(w, r1):
        return with_value(ending(w, "est en er st"), lambda e: F.when(inside(w, e, r1) & ((e != "st") | without(w, 2).rlike("^.{3,}(?<=[bdfghklmnt])$")), without(w, e)).otherwise(w))

    def third(w, r1, r2):
        def more(x, e, ends, before, unless=""):
            """The word x less one more ending in its region."""
            return with_value(ending(x, ends), lambda f: F.when(inside(x, f, before) & ~(without(x, f).endswith(unless) if unless else F.lit(False)), without(x, f)).otherwise(x))

        def cut(e):
            rest = without(w, e)
            return (
                F.when(~inside(w, e, r2), w).when(e.isin("end", "ung"), with_value(rest, lambda x: more(x, e, "ig", r2, "e"))).when(e.isin("ig", "ik", "isch"), F.when(rest.endswith("e"), w).otherwise(rest))
                .when(e.isin("lich", "heit"), with_value(rest, lambda x: more(x, e, "er en", r1))).otherwise(with_value(rest, lambda x: more(x, e, "lich ig", r2)))
            )

        return with_value(ending(w, "end ung isch ig ik lich heit keit"), cut)

    def stem(w, r1, r2):
        return chain(w, lambda x: first(x, r1), lambda x: second(x, r1), lambda x: third(x, r1, r2))

    return F.translate(with_value(marked, regions), "UYäöü", "uyaou")


# Fixed values of the Spanish rules.
ES = "aeiouáéíóúü"
ES_PRONOUNS = "selas selos sela selo las les los nos me se la le lo"
ES_1 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion"
ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
ES_GU = "en es éis emos"
ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)


def spanish(word: Column) -> Column:
    def start(w):
        """The region of verbs."""
        rest = lambda n, kind: F.regexp_extract(F.substring(w, n + 1, 99), f"^{kind}", 0)
        found = (
            F.when(w.rlike(f"^.[^{ES}]"), with_value(rest(2, f"[^{ES}]*[{ES}]"), lambda x: F.when(x == "", F.length(w)).otherwise(2 + F.length(x))))
            .when(w.rlike(f"^[{ES}][{ES}]"), with_value(rest(2, f"[{ES}]*[^{ES}]"), lambda x: F.when(x == "", F.length(w)).otherwise(2 + F.length(x)))).otherwise(3)
        )
        return F.when(F.length(w) < 3, F.length(w)).otherwise(found).cast("int")

    def pronouns(w, rv):
        def cut(e):
            rest = without(w, e)
            plain = F.translate(rest, "áéí", "aei")
            base = ending(rest, "iéndo ándo ár ér ír ando iendo ar er ir")
            verb = with_value(base, lambda b: inside(rest, b, rv)) | (rest.endswith("uyendo") & (F.length(rest) - 5 >= rv))
            return F.when(inside(w, e, rv) & verb, F.when(base.rlike("[áéí]"), swapped(rest, base, ending(plain, "iendo ando ar er ir"))).otherwise(rest)).otherwise(w)

        return with_value(ending(w, ES_PRONOUNS), cut)

    def more(x, ends, r2):
        return with_value(ending(x, ends), lambda f: F.when(inside(x, f, r2), without(x, f)).otherwise(x))

    def nouns(w, r1, r2):
        known = f"{ES_1} {ES_IC} logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos"

        def cut(e):
            rest = without(w, e)
            adverb = lambda x: with_value(ending(x, "ativ iv os ic ad"), lambda f: F.when((f == "ativ") & (F.length(x) - 4 >= r2), without(x, 4)).when(f == "ativ", F.when(F.length(x) - 2 >= r2, without(x, 2)).otherwise(x)).when(inside(x, f, r2), without(x, f)).otherwise(x))
            return (
                F.when(e == "", w).when(e == "amente", F.when(inside(w, e, r1), with_value(rest, adverb)).otherwise(w)).when(~inside(w, e, r2), w)
                .when(e.isin(*ES_IC.split()), with_value(rest, lambda x: more(x, "ic", r2))).when(e.isin("logía", "logías"), F.concat(rest, F.lit("log"))).when(e.isin("ución", "uciones"), F.concat(rest, F.lit("u")))
                .when(e.isin("encia", "encias"), F.concat(rest, F.lit("ente"))).when(e == "mente", with_value(rest, lambda x: more(x, "ante able ible", r2)))
                .when(e.isin("idad", "idades"), with_value(rest, lambda x: more(x, "abil ic iv", r2))).when(e.isin("iva", "ivo", "ivas", "ivos"), with_value(rest, lambda x: more(x, "at", r2))).otherwise(rest)
            )

        return with_value(ending(w, known), cut)

    def verbs(w, rv):
        tail = lambda ends: ending(F.substring(w, rv + 1, F.length(w)), ends)
        u = lambda x: F.when(x.endswith("gu"), without(x, 1)).otherwise(x)
        other = with_value(tail(f"{ES_GU} {ES_VERBS}"), lambda e: F.when(e == "", w).when(e.isin(*ES_GU.split()), with_value(without(w, e), u)).otherwise(without(w, e)))
        return with_value(tail(ES_Y), lambda e: F.when((e != "") & without(w, e).endswith("u"), without(w, e)).otherwise(other))

    def residue(w, rv):
        def cut(e):
            rest = without(w, e)
            return F.when(~inside(w, e, rv), w).when(e.isin("e", "é") & rest.endswith("gu") & (F.length(rest) - 1 >= rv), without(rest, 1)).otherwise(rest)

        return with_value(ending(w, "os a o á í ó e é"), cut)

    def stem(w, r):
        bare = lambda x: with_value(nouns(x, r["r1"], r["r2"]), lambda y: F.when(y != x, y).otherwise(verbs(x, r["rv"])))
        return chain(pronouns(w, r["rv"]), bare, lambda x: residue(x, r["rv"]))

    def regions(w):
        return with_value(region(w, ES), lambda r1: with_value(F.struct(r1.alias("r1"), region(w, ES, r1).alias("r2"), start(w).alias("rv")), lambda r: stem(w, r)))

    return F.translate(with_value(word, regions), "áéíóú", "aeiou")


LANGUAGES = {"english": english, "german": german, "spanish": spanish}


def stem(word: Column, language: str) -> Column:
    """The word's stem; words of a language without rules are their own."""
    return LANGUAGES.get(language, lambda w: w)(word)
