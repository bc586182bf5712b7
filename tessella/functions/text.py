"""Text normalization as column expressions, and the profile language that names chains of them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

AND_TOKENS = ("and", "et", "und")
DEFAULT_OPERATIONS = ("punctuation", "singlespace", "and", "singlechar", "diacritics", "lowercase")
TIERS = ("country", "region", "city")
WHITELIST = r"[^a-z0-9\s!&]"

#: Letters with digits, and marks, of Unicode 14 and 15, which Java 17's expressions don't know yet.
LATER_LETTERS = r"\x{870}-\x{887}\x{889}-\x{88E}\x{8B5}\x{8C8}-\x{8C9}\x{C5D}\x{CDD}\x{170D}\x{171F}\x{1B4C}\x{2C2F}\x{2C5F}\x{9FFD}-\x{9FFF}\x{A7C0}-\x{A7C1}\x{A7D0}-\x{A7D1}\x{A7D3}\x{A7D5}-\x{A7D9}\x{A7F2}-\x{A7F4}\x{10570}-\x{1057A}\x{1057C}-\x{1058A}\x{1058C}-\x{10592}\x{10594}-\x{10595}\x{10597}-\x{105A1}\x{105A3}-\x{105B1}\x{105B3}-\x{105B9}\x{105BB}-\x{105BC}\x{10780}-\x{10785}\x{10787}-\x{107B0}\x{107B2}-\x{107BA}\x{10F70}-\x{10F81}\x{11071}-\x{11072}\x{11075}\x{1123F}-\x{11240}\x{11740}-\x{11746}\x{11AB0}-\x{11ABF}\x{11F02}\x{11F04}-\x{11F10}\x{11F12}-\x{11F33}\x{11F50}-\x{11F59}\x{12F90}-\x{12FF0}\x{1342F}\x{13441}-\x{13446}\x{16A70}-\x{16ABE}\x{16AC0}-\x{16AC9}\x{1AFF0}-\x{1AFF3}\x{1AFF5}-\x{1AFFB}\x{1AFFD}-\x{1AFFE}\x{1B11F}-\x{1B122}\x{1B132}\x{1B155}\x{1DF00}-\x{1DF1E}\x{1DF25}-\x{1DF2A}\x{1E030}-\x{1E06D}\x{1E290}-\x{1E2AD}\x{1E4D0}-\x{1E4EB}\x{1E4F0}-\x{1E4F9}\x{1E7E0}-\x{1E7E6}\x{1E7E8}-\x{1E7EB}\x{1E7ED}-\x{1E7EE}\x{1E7F0}-\x{1E7FE}\x{2A6DE}-\x{2A6DF}\x{2B735}-\x{2B739}\x{31350}-\x{323AF}"
LATER_MARKS = r"\x{898}-\x{89F}\x{8CA}-\x{8D2}\x{C3C}\x{CF3}\x{ECE}\x{1715}\x{180F}\x{1AC1}-\x{1ACE}\x{1DFA}\x{10EFD}-\x{10EFF}\x{10F82}-\x{10F85}\x{11070}\x{11073}-\x{11074}\x{110C2}\x{11241}\x{11F00}-\x{11F01}\x{11F03}\x{11F34}-\x{11F3A}\x{11F3E}-\x{11F42}\x{13440}\x{13447}-\x{13455}\x{1CF00}-\x{1CF2D}\x{1CF30}-\x{1CF46}\x{1E08F}\x{1E2AE}\x{1E4EC}-\x{1E4EF}"

#: Letters of other scripts in Latin letters. Fixed values.
GREEK = {
    "Α": "A", "Β": "B", "Γ": "G", "Δ": "D", "Ε": "E", "Ζ": "Z", "Η": "I", "Θ": "TH", "Ι": "I", "Κ": "K", "Λ": "L", "Μ": "M",
    "Ν": "N", "Ξ": "X", "Ο": "O", "Π": "P", "Ρ": "R", "Σ": "S", "Τ": "T", "Υ": "Y", "Φ": "F", "Χ": "CH", "Ψ": "PS", "Ω": "O",
}
CYRILLIC = {
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "E", "Ж": "ZH", "З": "Z", "И": "I", "Й": "Y", "К": "K", "Л": "L", "М": "M", "Н": "N",
    "О": "O", "П": "P", "Р": "R", "С": "S", "Т": "T", "У": "U", "Ф": "F", "Х": "H", "Ц": "TS", "Ч": "CH", "Ш": "SH", "Щ": "SHT", "Ъ": "A", "Ы": "Y",
    "Ь": "", "Э": "E", "Ю": "YU", "Я": "YA", "Ђ": "D", "Ѕ": "DZ", "Ј": "J", "Љ": "LJ", "Њ": "NJ", "Ћ": "C", "Џ": "DZH",
}
LATIN = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Ð": "D", "ð": "d", "Þ": "TH", "þ": "th",
    "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "ı": "i", "Ħ": "H", "ħ": "h",
}


def clean_text(c: Column) -> Column:
    """Without outer Unicode white space; blank becomes null."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def coalesce_text(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*map(clean_text, columns))


def punctuation(c: Column, keep: str = "&") -> Column:
    return F.regexp_replace(c, rf"(?U)[^\w\s{keep}]|_", " ")


def single_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def and_words(c: Column, words: Sequence[str] = AND_TOKENS) -> Column:
    """Whole connector words as '&', every '&' with one space around it; a lone '&' stays bare."""
    joined = F.regexp_replace(c, r"(?U)\s*&\s*", " & ")
    if words:
        joined = F.regexp_replace(F.regexp_replace(joined, rf"(?iU)(?<!\w)(?:{'|'.join(words)})(?!\w)", " & "), r"(?U)\s*&\s*", " & ")
    return F.when(F.trim(joined) == "&", F.lit("&")).otherwise(joined)


def single_chars(c: Column) -> Column:
    """Runs of one-character tokens as one token: 'S R L' as 'SRL', 'P & S' as 'P&S', 'A T & T' as 'AT & T'."""
    spaced = F.when(c.contains("&") & c.rlike(r"(?U)[\p{L}\p{N}]"), F.regexp_replace(c, r"(?U)\s*&\s*", " & ")).otherwise(c)
    runs = F.regexp_replace(spaced, r"(?U)(?<=(?:^|\s)[\p{L}\p{N}])\s+(?=[\p{L}\p{N}](?:\s|$))", "")
    return F.regexp_replace(runs, r"(?U)(?<=(?:^|\s)[\p{L}\p{N}])\s+&\s+(?=[\p{L}\p{N}](?:\s|$))", "&")


@lru_cache
def _folds() -> tuple[str, str]:
    """Letters of the alphabetic blocks whose compatibility form without marks is one other letter."""
    pairs = []
    for code in (*range(0xA0, 0x590), *range(0x1D00, 0x2000), *range(0xFF00, 0xFF60)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_diacritics(c: Column) -> Column:
    """Without combining marks, letters of Latin, Greek, Cyrillic and full-width blocks in compatibility form. Characters whose form is several letters (ligatures) stay; see strip_diacritics_full."""
    old, new = _folds()
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.regexp_replace(F.translate(c, old, new), r"\p{M}+", ""))


def strip_diacritics_full(c: Column) -> Column:
    """NFKD without combining marks for every character, in Arrow batches."""
    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))

    return strip(c)


def letters_only(c: Column, keep: str = "&") -> Column:
    """Letters, marks, decimal digits, white space and what is kept; each other character, underscores too, as a space."""
    return F.regexp_replace(c, rf"[^\p{{L}}\p{{M}}\p{{Nd}}\s{keep}[{LATER_LETTERS}{LATER_MARKS}]]", " ")


def and_tokens(c: Column, words: Sequence[str] = AND_TOKENS) -> Column:
    """As and_words for a text with single spaces, but only tokens between spaces are connectors and a lone '&' gets its spaces too."""
    joined = F.regexp_replace(c, r"\s*&\s*", " & ")
    return F.regexp_replace(F.regexp_replace(joined, rf"(?i)(?<![^ ])(?:{'|'.join(words)})(?![^ ])", "&"), r"\s*&\s*", " & ")


def strip_accents(c: Column) -> Column:
    """Canonical form without marks, composed again, for every character: compatibility forms (full-width letters, ª, ſ) stay what they are."""
    normalizer = lambda name, x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(name), x, F.lit(False))
    return F.when(c.isNull() | c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(normalizer("compose", F.regexp_replace(normalizer("decompose", c), rf"\p{{M}}+|[\x{{800}}-\x{{10FFFF}}&&[{LATER_MARKS}]]+", "")))


def lower_letters(c: Column) -> Column:
    """Lower case letter by letter: a sigma is the same at a word's end."""
    return F.lower(F.replace(c, F.lit("Σ"), F.lit("σ")))


def transliterate(c: Column) -> Column:
    """Greek, Cyrillic and special Latin letters in ASCII, after diacritics."""
    table = dict(LATIN)
    for letters in (GREEK, CYRILLIC):
        table |= letters | {k.lower(): v.lower() for k, v in letters.items()}
    table["ς"] = "s"
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(strip_diacritics(c), "".join(single), "".join(single.values()))
    for k, v in table.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(out)


def casefold(c: Column) -> Column:
    """Lower case with sharp s as ss and final sigma as sigma."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")


def strip_geographic(c: Column, terms: Sequence[str], least_tokens: int = 2) -> Column:
    """Without a bracketed term, or a trailing one if least_tokens stay and no connector stands before it."""
    if not terms:
        return c
    any_term = "|".join(sorted((t.lower().replace(" ", r"\s+") for t in terms), key=len, reverse=True))
    bare = F.regexp_replace(c, rf"(?iU)\s*[(\[](?:{any_term})[)\]]", "")
    head = F.regexp_replace(bare, rf"(?iU)\s+(?:{any_term})\s*$", "")
    tokens = F.split(F.trim(head), r"\s+")
    connected = F.lower(F.element_at(tokens, -1)).isin("of", "the", "and", "&", "de", "la", "von", "in", "for")
    return F.when((head != bare) & (F.size(tokens) >= least_tokens) & ~connected, head).otherwise(bare)


OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "punctuation": punctuation,
    "punctuation_bang": lambda c: punctuation(c, "&!"),
    "singlespace": single_space,
    "and": and_words,
    "singlechar": single_chars,
    "diacritics": strip_diacritics,
    "transliterate": transliterate,
    "lowercase": F.lower,
    "letters": letters_only,
    "andtokens": and_tokens,
    "accents": strip_accents,
    "lowerletters": lower_letters,
    "casefold": casefold,
}


def parse_profile(profile: str | None) -> tuple[str, ...]:
    """The operations a profile names.

    'default' is the default chain; '-x' leaves an operation out; a bare name adds one before the case step (casefold
    and geographic_terms at the end); '+tier' adds a tier to geographic_terms (short: geographic), written
    'geographic_terms+tier'. Without 'default' the names are the whole chain.
    """
    parts = [p.strip().lower() for p in (profile or "default").split("|") if p.strip()] or ["default"]
    tiers = [p[1:] for p in parts if p[0] == "+"]
    names = ["geographic_terms" if p == "geographic" else p for p in parts if p[0] != "+"] or ["default"]
    chain = list(DEFAULT_OPERATIONS) if names[0] == "default" else []
    for name in names[1:] if names[0] == "default" else names:
        base = name.lstrip("-")
        if base not in OPERATIONS and base != "geographic_terms":
            raise ValueError(f"unknown operation {base!r} in profile {profile!r}")
        if name[0] == "-":
            if base not in chain:
                raise ValueError(f"{base!r} isn't in the chain of profile {profile!r}")
            chain.remove(base)
        elif name not in chain:
            case = next((k for k, x in enumerate(chain) if x in ("lowercase", "casefold")), len(chain))
            chain.insert(case if names[0] == "default" and name not in ("casefold", "geographic_terms") else len(chain), name)
    if {"lowercase", "casefold"} <= set(chain):
        raise ValueError("lowercase and casefold exclude each other")
    if tiers:
        if "geographic_terms" not in chain:
            raise ValueError("a tier needs geographic_terms")
        if bad := set(tiers) - set(TIERS):
            raise ValueError(f"unknown tiers {sorted(bad)}")
        chain[chain.index("geographic_terms")] = "geographic_terms" + "".join(f"+{t}" for t in TIERS[1:] if t in tiers)
    return tuple(chain)


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it: the optimizer would copy c into each use."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))  # f may have further parameters


def normalize(c: Column, profile: str | Sequence[str] | None = None, *, geographic: dict[str, Sequence[str]] | None = None) -> Column:
    """A text through a profile's chain; geographic: terms by tier."""
    chain = parse_profile(profile) if profile is None or isinstance(profile, str) else tuple(profile)

    def step(text: Column, name: str) -> Column:
        if name.startswith("geographic_terms"):
            tiers = ("country", *name.split("+")[1:])
            return bind(text, lambda x: strip_geographic(x, [t for tier in tiers for t in (geographic or {}).get(tier, ())]))
        return bind(text, OPERATIONS[name])

    return reduce(step, chain, c)


def whitelist(c: Column, pattern: str = WHITELIST) -> Column:
    """Characters outside the whitelist as spaces, squeezed."""
    return single_space(F.regexp_replace(c, pattern, " "))


def tokens(c: Column) -> Column:
    """Non-blank white-space tokens; an empty array for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


def ngrams(c: Column, low: int, high: int, kind: str = "char_wb") -> Column:
    """Character n-grams of each word padded with a space (char_wb), of the whole text (char), or word n-grams (word).

    In char_wb, a padded word no longer than n is given once whole, at the first such n.
    """
    if kind == "word":
        words = tokens(c)

        def runs(n: int) -> Column:
            grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
            return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

        return F.concat(*map(runs, range(low, high + 1)))

    def windows(text: Column, n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    if kind == "char":
        return F.concat(*(windows(F.coalesce(c, F.lit("")), n) for n in range(low, high + 1)))

    def of_word(word: Column) -> Column:
        text = F.concat(F.lit(" "), word, F.lit(" "))
        first = F.length(text) <= low
        parts = [F.when(F.length(text) > n, windows(text, n)).when((F.length(text) == n) | (first & F.lit(n == low)), F.array(text)).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.concat(*parts)

    return F.flatten(F.transform(tokens(c), of_word))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays as sets; null if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either)


def char_trigram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard of character n-grams of texts padded with one space on each side, case kept."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(pad(c)) - n + 1, F.lit(1))), lambda i: F.substr(pad(c), i, F.lit(n)))
    return jaccard(grams(a), grams(b))


def inactive(status: Column) -> Column:
    """Whether a company status tells of an end; null is active."""
    return F.coalesce(F.lower(status).rlike("dissolv|liquidat|struck off|removed|inactive|closed|cess"), F.lit(False))


def iso_date(*columns: Column) -> Column:
    """The first column that is a date in one of the known forms, as yyyy-MM-dd."""
    forms = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy", "yyyyMMdd")
    return F.date_format(F.coalesce(*(F.try_to_timestamp(clean_text(c), F.lit(f)) for c in columns for f in forms)), "yyyy-MM-dd")


def address(*parts: Column) -> Column:
    """Non-blank parts joined by a comma; null without any."""
    return F.nullif(F.concat_ws(", ", *map(clean_text, parts)), F.lit(""))


def has_latin(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{IsLatin}"), F.lit(False))


def initials(tokens: Column) -> Column:
    """First letters of an array of tokens."""
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def initialism(a: Column, b: Column) -> Column:
    """Whether two token arrays share no token and one is a single token, the other's initials."""
    spells = lambda x, y: (F.size(x) == 1) & (F.size(y) >= 2) & (F.get(x, F.lit(0)) == initials(y))
    return ~F.arrays_overlap(a, b) & (spells(a, b) | spells(b, a))


def divergence(a: Column, b: Column, most: int = 2) -> Column:
    """'prefix' or 'suffix' if the shorter token array begins or ends the longer one and at most `most` tokens are left; else null."""
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    extra = F.size(long) - F.size(short)
    ok = (extra >= 1) & (extra <= most) & (F.size(short) >= 1)
    return F.when(ok & (F.slice(long, 1, F.size(short)) == short), "prefix").when(ok & (F.slice(long, extra + 1, F.size(short)) == short), "suffix")
