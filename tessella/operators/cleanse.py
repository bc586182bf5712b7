"""Name to name forms: legal form, cleansed name, short name, quoted name, acronym. Column expressions, one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import initials, normalize, single_space, tokens, transliterate, whitelist

#: Normalised spelling of a legal form and its canonical form, from public registers' abbreviations; a caller may bring others. Fixed values.
LEGAL_FORMS = {
    "limited": "ltd", "ltd": "ltd", "public limited company": "plc", "plc": "plc", "limited liability partnership": "llp", "llp": "llp",
    "limited liability company": "llc", "llc": "llc", "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "company": "co", "co": "co",
    "co ltd": "co ltd", "company limited": "co ltd", "designated activity company": "dac", "dac": "dac", "unlimited company": "uc", "gmbh": "gmbh",
    "gesellschaft mit beschrankter haftung": "gmbh", "gmbh & co kg": "gmbh & co kg", "ag": "ag", "aktiengesellschaft": "ag", "kg": "kg", "ohg": "ohg", "ug": "ug", "ev": "ev",
    "sarl": "sarl", "sa": "sa", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sci": "sci", "snc": "snc", "bv": "bv", "nv": "nv", "srl": "srl", "spa": "spa", "sl": "sl",
    "slu": "slu", "ab": "ab", "as": "as", "oy": "oy", "aps": "aps", "lda": "lda",
}
#: Words that carry no name: anywhere, or only at the end. A caller may bring others. Fixed values.
NOISE_ANYWHERE = ("the",)
NOISE_SUFFIX = ("group", "holding", "holdings", "international", "services", "solutions", "systems", "partners", "gruppe", "groupe")


@dataclass(frozen=True)
class CleanseConfig:
    name_col: str = "name"
    profile: str = "default"
    legal_forms: Mapping[str, str] = field(default_factory=lambda: LEGAL_FORMS)
    noise_anywhere: Sequence[str] = NOISE_ANYWHERE
    noise_suffix: Sequence[str] = NOISE_SUFFIX
    owner_markers: Sequence[str] = ()
    source_type_col: str | None = None
    source_types: Mapping[str, str] = field(default_factory=dict)
    country_col: str | None = None
    country_forms: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    country_exclusions: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def forms_of(self, country: str) -> dict[str, str]:
        """The legal forms of a country: the common ones without those it excludes, and its own, which win."""
        left_out = set(self.country_exclusions.get(country, ()))
        return {k: v for k, v in self.legal_forms.items() if k not in left_out} | dict(self.country_forms.get(country, {}))


def _map(values: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def legal_suffix(words: Column, forms: Mapping[str, str]) -> Column:
    """Tokens of the longest legal form that ends a token array and leaves at least one token before it; 0 for none.

    Forms are known by their number of tokens, so that each tail is looked up once, in a hashed set of the forms of its length.
    """
    by_length: dict[int, list[str]] = {}
    for form in forms:
        by_length.setdefault(len(form.split()), []).append(form)
    found = F.lit(0)
    for n, known in sorted(by_length.items()):
        found = F.when((F.size(words) > n) & F.array_join(F.slice(words, -n, n), " ").isin(known), n).otherwise(found)
    return found


def by_country(config: CleanseConfig, use: Callable[[Mapping[str, str]], Column]) -> Column:
    """use(forms) with the forms of each row's country; the common forms where the country has no rules of its own."""
    countries = sorted({*config.country_forms, *config.country_exclusions})
    if not config.country_col or not countries:
        return use(config.legal_forms)
    code, chosen = F.lower(F.trim(config.country_col)), use(config.legal_forms)
    for country in countries:
        chosen = F.when(code == country, use(config.forms_of(country))).otherwise(chosen)
    return chosen


def trim_noise(words: Column, anywhere: Sequence[str], suffix: Sequence[str]) -> Column:
    """Without noise words: those for anywhere from left to right while more than one token stays, then trailing ones, never the first token."""
    some = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.size(words).alias("left"))

    def step(acc: Column, w: Column) -> Column:
        drop = F.array_contains(some(anywhere), w) & (acc["left"] > 1)
        return F.struct(F.when(drop, acc["kept"]).otherwise(F.array_append(acc["kept"], w)).alias("kept"), F.when(drop, acc["left"] - 1).otherwise(acc["left"]).alias("left"))

    kept = F.aggregate(words, start, step, lambda acc: acc["kept"])
    trailing = F.aggregate(F.reverse(kept), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, w: F.struct((acc["n"] + (acc["on"] & F.array_contains(some(suffix), w)).cast("int")).alias("n"), (acc["on"] & F.array_contains(some(suffix), w)).alias("on")), lambda acc: acc["n"])
    return F.slice(kept, 1, F.greatest(F.size(kept) - trailing, F.least(F.size(kept), F.lit(1))))


def acronym(short: Column, words: Column) -> Column:
    """The lower-cased short name if it equals the first letters of the tokens."""
    text = F.lower(F.trim(short))
    return F.when((text != "") & (text == F.lower(initials(words))), text)


#: Words without an initial of their own. A caller may bring others. Fixed values.
STOPWORDS = ("and", "of", "the", "for", "in", "de", "la", "et", "und", "der", "die", "das", "fur", "von", "&")
SHORT_NAME_LAYERS = ("subsequence_initials", "exact_initials", "prefix_truncation", "prefix_acronym")


def short_name_layer(words: Column, layer: str, *, forms: Mapping[str, str] = LEGAL_FORMS, stopwords: Sequence[str] = STOPWORDS, split: Callable[[Column], Column] | None = None) -> Column:
    """A short name of a lower-cased token array by one pattern, null where it doesn't fit.

    exact_initials: all tokens' first letters, of at least two. subsequence_initials: those of the tokens that are no stop words and
    no legal forms, if they differ from all tokens'. prefix_truncation: the name without trailing numbers and legal forms.
    prefix_acronym: the initials of the hyphenated first token's parts, then the other tokens without trailing legal forms.
    split: an array of parts of each token of an array, for compounds; each part gives an initial.
    """
    types = F.array(*(F.lit(t) for t in sorted({t for k in forms for t in k.split()})))
    stops = F.array(*(F.lit(w) for w in stopwords)) if stopwords else F.array().cast("array<string>")
    is_type = lambda t: F.array_contains(types, t)
    spelled = lambda arr: initials(split(arr) if split else arr)

    def without_tail(arr: Column, drop: Callable[[Column], Column]) -> Column:
        state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
        step = lambda acc, t: F.struct((acc["n"] + (acc["on"] & drop(t)).cast("int")).alias("n"), (acc["on"] & drop(t)).alias("on"))
        return F.slice(arr, 1, F.size(arr) - F.aggregate(F.reverse(arr), state, step, lambda acc: acc["n"]))

    if layer == "exact_initials":
        return F.when(F.size(words) >= 2, spelled(words))
    if layer == "subsequence_initials":
        content = F.filter(words, lambda t: ~F.array_contains(stops, t) & ~is_type(t))
        return F.when((F.size(content) >= 2) & (spelled(content) != spelled(words)), spelled(content))
    if layer == "prefix_truncation":
        kept = without_tail(words, lambda t: F.regexp_replace(t, "[.,]", "").rlike("^[0-9]+$") | is_type(t))
        return F.when((F.size(kept) > 0) & (F.size(kept) < F.size(words)), F.array_join(kept, " "))
    if layer == "prefix_acronym":
        parts = F.filter(F.split(F.get(words, F.lit(0)), "-"), lambda p: p != "")
        rest = without_tail(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), is_type)
        return F.when((F.size(words) >= 2) & (F.size(parts) >= 2), F.array_join(F.concat(F.array(spelled(parts)), rest), " "))
    raise ValueError(f"unknown layer {layer!r}")


def short_name_candidate(words: Column, layers: Sequence[str] = SHORT_NAME_LAYERS, **options) -> Column:
    """The first layer's short name that fits."""
    return F.coalesce(*(short_name_layer(words, layer, **options) for layer in layers))


def parse_preprocessing(profile: str) -> tuple[bool, str | None]:
    """Whether the legal form goes, and the noise level that goes, of 'default', '-company_type' and '+noise_words:<level>'."""
    first, *rest = [p.strip() for p in profile.split("|")]
    if first != "default":
        raise ValueError(f"a preprocessing profile starts with default: {profile!r}")
    drop_form, level = True, None
    for part in rest:
        name, _, value = part.partition(":")
        if part == "-company_type":
            drop_form = False
        elif name == "+noise_words" and value.strip():
            level = value.strip()
        else:
            raise ValueError(f"unknown step {part!r} in {profile!r}")
    return drop_form, level


def preprocess_names(df: DataFrame, profile: str = "default", *, name_col: str = "name", out_col: str = "name_preprocessed", noise: Mapping[str, Sequence[str]] | None = None, forms: Mapping[str, str] = LEGAL_FORMS) -> DataFrame:
    """df with the text a tokenizer or vectorizer reads: always normalised, without the legal form and the level's trailing noise words as the profile says.

    noise: trailing words by level; by default every level has the package's own. Names left empty are null.
    """
    drop_form, level = parse_preprocessing(profile)
    step = df.select("*", F.explode(F.array(tokens(whitelist(F.lower(normalize(transliterate(F.coalesce(F.col(name_col), F.lit(""))), "default")))))).alias(out_col))
    words = F.col(out_col)
    if drop_form:
        words = F.slice(words, 1, F.size(words) - legal_suffix(words, forms))
    if level is not None:
        words = trim_noise(words, NOISE_ANYWHERE, (noise or {}).get(level, NOISE_SUFFIX))
    return step.withColumn(out_col, F.nullif(F.array_join(words, " "), F.lit("")))


def cleanse(df: DataFrame, config: CleanseConfig = CleanseConfig()) -> DataFrame:
    """df with name_cleansed_basic, name_cleansed, company_type, company_type_source, short_name, quoted_name, acronym, personal_owner.

    The name is normalised by the profile and cut to the whitelist (basic). A trailing legal form, tried as spelled and then
    transliterated, is replaced by its canonical form (cleansed) and gives company_type (name_suffix); else the source's own
    type does (source_mapping), else 'private' (default_private). A country (country_col; keys in lower case) may have forms of its own and
    exclude common ones. A leading bracketed or quoted token of at least two letters or
    digits is taken out of the name; it is the acronym if it spells the other tokens' initials, else a quoted one leads the
    cleansed name. short_name is the name without legal form and noise words, never empty for a name with a token. A null
    or blank name has null forms.
    """
    name = F.trim(F.regexp_replace(F.coalesce(F.col(config.name_col), F.lit("")), r"(?U)\s+", " "))
    owner = F.lit(None).cast("string")
    if config.owner_markers:
        marked = rf"(?i)^(.*\S)\s+(?:{'|'.join(config.owner_markers)})\s+(\S.*)$"
        owner = F.nullif(F.regexp_extract(name, marked, 2), F.lit(""))
        name = F.when(name.rlike(marked), F.regexp_extract(name, marked, 1)).otherwise(name)
    lead = r"^(?:\(([^()]+)\)|[\"“„«]([^\"“”„»]+)[\"”“»])\s+(?=\S)"
    bracketed, quoted = F.regexp_extract(name, lead, 1), F.regexp_extract(name, lead, 2)
    usable = lambda c: F.length(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]", "")) >= 2
    led = usable(F.concat(bracketed, quoted)) & (F.lower(F.concat(bracketed, quoted)) != "the")
    body = F.when(led, F.regexp_replace(name, lead, "")).otherwise(name)
    body = F.regexp_replace(body, r"(?i)^(.*\S)\s*\(the\)$", "the $1")
    step = df.select("*", owner.alias("personal_owner"), F.when(led, F.nullif(F.trim(F.concat(bracketed, quoted)), F.lit(""))).alias("_lead"), F.when(led & (quoted != ""), F.trim(quoted)).alias("quoted_name"), F.explode(F.array(body)).alias("_body"))
    step = step.select("*", F.explode(F.array(F.struct(tokens(whitelist(normalize(F.col("_body"), config.profile))).alias("plain"), tokens(whitelist(F.lower(normalize(transliterate(F.col("_body")), config.profile)))).alias("latin")))).alias("_t"))
    words = F.when(by_country(config, lambda forms: legal_suffix(F.col("_t.plain"), forms)) > 0, F.col("_t.plain")).otherwise(F.col("_t.latin"))
    step = step.select("*", words.alias("_w")).select("*", by_country(config, lambda forms: legal_suffix(F.col("_w"), forms)).alias("_n"))
    base = F.slice("_w", 1, F.greatest(F.size("_w") - F.col("_n"), F.lit(0)))
    tail = F.array_join(F.slice("_w", F.greatest(F.size("_w") - F.col("_n") + 1, F.lit(1)), F.col("_n")), " ")
    form = by_country(config, lambda forms: _map(forms)[tail])
    given = _map(config.source_types)[F.lower(F.trim(config.source_type_col))] if config.source_type_col and config.source_types else F.lit(None).cast("string")
    step = step.select("*", base.alias("_base"), F.when(F.col("_n") > 0, form).alias("_form"), given.alias("_given"))
    step = step.select("*", acronym(F.col("_lead"), F.col("_base")).alias("acronym"))
    whole = single_space(F.concat_ws(" ", F.array_join("_base", " "), "_form"))
    mark = F.lower("quoted_name")
    fronted = F.when(mark.isNotNull() & ~F.coalesce(mark == F.col("acronym"), F.lit(False)) & ~whole.startswith(mark), F.concat_ws(" ", mark, whole)).otherwise(whole)
    out = step.select(
        *df.columns,
        F.nullif(F.array_join("_t.plain", " "), F.lit("")).alias("name_cleansed_basic"),
        F.nullif(fronted, F.lit("")).alias("name_cleansed"),
        F.when(F.size("_w") > 0, F.coalesce("_form", "_given", F.lit("private"))).alias("company_type"),
        F.when(F.size("_w") > 0, F.when(F.col("_form").isNotNull(), "name_suffix").when(F.col("_given").isNotNull(), "source_mapping").otherwise("default_private")).alias("company_type_source"),
        F.nullif(F.array_join(trim_noise(F.col("_base"), config.noise_anywhere, config.noise_suffix), " "), F.lit("")).alias("short_name"),
        "quoted_name", "acronym", "personal_owner",
    )
    return out


def empty_audit(cleansed: DataFrame, config: CleanseConfig = CleanseConfig()) -> DataFrame:
    """Rows with a name that cleansed to nothing."""
    return cleansed.where((F.trim(config.name_col) != "") & F.col("name_cleansed").isNull())


def split_compound(c: Column, lexicon: Mapping[str, int], *, least: int = 3) -> Column:
    """Parts of compound words: the two-way split of known words with the greatest geometric mean frequency above the word's own, recursively."""
    def best(word: str) -> list[str]:
        found, most = None, float(lexicon.get(word, 0))
        for i in range(least, len(word) - least + 1):
            a, b = lexicon.get(word[:i], 0), lexicon.get(word[i:], 0)
            if a and b and (a * b) ** 0.5 > most:
                found, most = i, (a * b) ** 0.5
        return [word] if found is None else best(word[:found]) + best(word[found:])

    @F.pandas_udf("array<string>")
    def split(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else best(w.lower()))

    return split(c)


def propose_forms(df: DataFrame, type_col: str, words_col: str, *, known: Sequence[str], least: int = 10) -> DataFrame:
    """last_token, rows: frequent last tokens of names without a legal form that are no known form."""
    rows = df.where((F.col(type_col) == "private") & (F.size(words_col) > 1)).groupBy(F.element_at(words_col, -1).alias("last_token")).agg(F.count("*").alias("rows"))
    return rows.where((F.col("rows") >= least) & ~F.col("last_token").isin(list(known)))
