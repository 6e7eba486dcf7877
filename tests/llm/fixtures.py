"""Documents with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n long, row long, seg string"


def prose(rng, n, words=tuple("the of and to in that river house stone bread water night quiet open walk under green seven Straße école niño".split())):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "ed", "ing"]) for _ in range(n))


def rows():
    rng = random.Random(5)
    passage = prose(rng, 40)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    texts = [None, "", " \t\n\v\f\r ", "a", "\x00\x00" * 60, "ab" * 500, "aaaa" * 400, "é" * 120]
    texts += base
    texts += [t + " extra" for t in base[:10]] + base[:6] + [base[0]] * 5
    texts += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 25) for _ in range(6)]
    texts += [base[3][:60] + prose(rng, 50), prose(rng, 9000), "x" * 50_000, "7" * 20_000, "1.2.3." * 3000]
    texts += ["mail me a.b+c@ex-ample.co.uk or x@y, ip 10.0.0.256 then 192.168.1.77.9 card 4111 1111 1111 1111 tel +49 (0)30 1234-567. (555) 123-4567 call", "contact joe(at)mail.com, ssn 123-45-6789 iban DE89370400440532013000", "+1 2 3", "a@b.c.d@e.f _x@y.z", "card 4111 1111 1111 1112 @@ @a.b"]
    texts += ["line one here\nline one here\nline two\n\n  \nline one here ", "x y z x y z x y z w", "#$ %& <tag> | *", "<|endoftext|> 's don't I'LL ÀÉ ß x ǅ İ Σς é ́a"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["big", "big", "big", "a.example.com", "b.example.com", None]), None if t is None else len(t), True, 1, 2, "s") for i, t in enumerate(texts)]
    rng.shuffle(out)
    out += [out[3], out[3], (None, base[1], "en", "big", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None), (10_000, base[2], "xx", "big", 0, False, 0, 0, ""), (out[7][0], base[4], "en", "big", 0, False, 0, 0, "")]
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
