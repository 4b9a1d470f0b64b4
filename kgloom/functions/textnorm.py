"""Column expressions over terms, labels, URIs and N-Triples tokens (P1-P27). All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word for a one-letter part of speech in sense tokens.
POS_WORDS = {"n": "noun", "v": "verb", "a": "adj", "r": "adv", "s": "adj"}
#: Ordered patterns that name the source of a URI.
SOURCE_PATTERNS = [
    ("geonames", r"geonames"),
    ("wordnet", r"wordnet|wn\.|/wn/"),
    ("wiktionary", r"wiktionary|wkt"),
    ("conceptnet", r"conceptnet|/c/en/|example\.org/ontology"),
]
#: Sentence templates of relations.
TEMPLATES = {
    "eq": "{s} is equivalent to {o}",
    "synonym": "{s} is a synonym of {o}",
    "isA": "{s} is a type of {o}",
    "instanceOf": "{s} is an instance of {o}",
    "partOf": "{s} is part of {o}",
    "formOf": "{s} is a form of {o}",
    "alternativeOf": "{s} is an alternative form of {o}",
    "relatedTo": "{s} is related to {o}",
    "derivedFrom": "{s} is derived from {o}",
    "etymologicallyRelatedTo": "{s} is etymologically related to {o}",
    "neqTo": "{s} is distinct from {o}",
    "antonym": "{s} is the opposite of {o}",
    "distinctFrom": "{s} is distinct from {o}",
    "similarTo": "{s} is similar to {o}",
    "hasContext": "{s} belongs to the domain of {o}",
    "atLocation": "{s} is found at {o}",
    "compositeFormWith": "{s} forms a compound expression with {o}",
    "capableOf": "{s} is capable of {o}",
    "receivesAction": "{s} receives the action {o}",
    "usedFor": "{s} is used for {o}",
    "causes": "{s} causes {o}",
    "mannerOf": "{s} is a manner of {o}",
    "madeOf": "{s} is made of {o}",
    "hasProperty": "{s} has the property of being {o}",
    "hasA": "{s} has {o}",
}
_EDGE = r"^[\s   -     　\u0085\u001c-\u001f]+|[\s   -     　\u0085\u001c-\u001f]+$"
_XSD = "http://www.w3.org/2001/XMLSchema#"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """All Unicode white space off both ends."""
    return F.regexp_replace(_col(c), _EDGE, "")


def normalise_term(c) -> Column:
    """Underscores to spaces, double quotes dropped, stripped unless the result is exactly one space."""
    t = F.replace(F.replace(_col(c), F.lit("_"), F.lit(" ")), F.lit('"'), F.lit(""))
    return F.when(t == " ", t).otherwise(strip(t))


def lemma_pos(pos) -> Column:
    """lemmatiser's letter of a part of speech, by substring in the order verb, adj, adv ("adverb" is v)."""
    p = F.lower(_col(pos))
    return F.when(p.contains("verb"), "v").when(p.contains("adj"), "a").when(p.contains("adv"), "r").otherwise("n")


def lemmatised(df, lemmas, term: str = "term", pos: str = "pos", out: str = "lemma"):
    """Df with the lemma of the lower-cased term for the letter of its part of speech; the lower-cased term where the table
    has none. lemmas (word, letter, lemma) stands for a lemmatiser's exceptions; of several lemmas the least counts."""
    one = lemmas.groupBy(F.lower("word").alias("_word"), F.col("letter").alias("_letter")).agg(F.min("lemma").alias("_lemma"))
    found = df.join(one, (F.lower(F.col(term)) == F.col("_word")) & (lemma_pos(pos) == F.col("_letter")), "left")
    return found.select(*df.columns, F.coalesce("_lemma", F.lower(F.col(term))).alias(out))


def normalise_data(term, mode: str, lemma=None) -> Column:
    """The term in mode full (normalised), raw (normalised, labels untouched elsewhere) or canonicalise (lemma of the lower-cased term)."""
    if mode not in ("full", "raw", "canonicalise"):
        raise ValueError(f"unknown mode {mode}")
    t = normalise_term(term)
    return t if mode != "canonicalise" else F.coalesce(lemma if lemma is not None else F.lit(None).cast("string"), F.lower(t))


def percent_quote(c) -> Column:
    """Percent-encoding that leaves letters, digits, _ . - ~ and /."""
    q = F.url_encode(_col(c))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return q


def percent_unquote(c) -> Column:
    """Percent-decoding that leaves a plus sign as it is; text with a broken escape stays whole."""
    plus = F.replace(_col(c), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plus), _col(c))


def safe_uri(term, sense=None, base: str = "http://kgloom.example/") -> Column:
    """URI of a term, quoted only where needed, with the normalised sense after two hyphens."""
    def quoted(c):
        return F.when(c.rlike(r"[^a-zA-Z0-9_-]"), percent_quote(c)).otherwise(c)

    uri = F.concat(F.lit(base), quoted(_col(term)))
    if sense is None:
        return uri
    s = _col(sense)
    return F.when(s.isNull() | (s == ""), uri).otherwise(F.concat(uri, F.lit("--"), F.regexp_replace(s, r"[^a-zA-Z0-9_-]", "-")))


def uri_parts(c) -> dict[str, Column]:
    """Lang, term, pos and subsense of a /c/<lang>/<term>[/<pos>[/...]] URI; the bare part of speech falls back to segment 1."""
    parts = F.split(_col(c), "/")
    rest = F.slice(parts, 6, 1 << 20)
    return {
        "lang": F.get(parts, F.lit(2)),
        "term": F.get(parts, F.lit(3)),
        "pos": F.coalesce(F.get(parts, F.lit(4)), F.get(parts, F.lit(1))),
        "subsense": F.when(F.size(rest) > 0, F.replace(F.array_join(rest, "/"), F.lit("_"), F.lit(" "))),
    }


def sense_token(pos, subsense) -> Column:
    """P10: pos/subsense, null without a subsense."""
    return F.when(_col(subsense).isNotNull() & (_col(subsense) != ""), F.concat_ws("/", _col(pos), _col(subsense)))


def supersense(c) -> Column:
    """Pos.domain of a sense, null where there is none."""
    s = _col(c)
    parts = F.split(s, "/")
    head = F.get(parts, F.lit(0))
    word = F.coalesce(F.create_map(*[x for k, v in POS_WORDS.items() for x in (F.lit(k), F.lit(v))])[head], head)
    return F.when(s.isNull() | (s == ""), None).when(s.contains(".") & ~s.contains("/"), s).when((F.size(parts) >= 3) & (F.get(parts, F.lit(1)) == "wn"), F.concat(word, F.lit("."), F.get(parts, F.lit(2))))


def local_name(c) -> Column:
    """After the last slash, then after the last hash."""
    return F.substring_index(F.substring_index(_col(c), "/", -1), "#", -1)


def base_relation(c) -> Column:
    """A reified predicate without its number."""
    return F.regexp_replace(_col(c), r"\d+>$", ">")


def detect_source(c, patterns: list[tuple[str, str]] | None = None) -> Column:
    """The first source whose pattern the URI has, else unknown. patterns: (name, pattern) in order, SOURCE_PATTERNS if None."""
    out = None
    for name, pattern in SOURCE_PATTERNS if patterns is None else patterns:
        hit = _col(c).rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def meaningful(c) -> Column:
    """At least three characters, not digits or hex alone, at most half underscores, some letter."""
    t = F.coalesce(_col(c), F.lit(""))
    n = F.length(t)
    return (n >= 3) & ~t.rlike(r"^\d+$") & ~t.rlike(r"(?i)^[0-9a-f\-]{8,}$") & ((n - F.length(F.replace(t, F.lit("_"), F.lit("")))) <= n * 0.5) & t.rlike("[a-zA-Z]")


def pair_label(c) -> Column:
    """Lower-case label of a URI for pair mining."""
    bare = F.regexp_replace(_col(c), ">+$", "")
    return F.lower(F.replace(percent_unquote(F.substring_index(F.substring_index(bare, "#", -1), "/", -1)), F.lit("_"), F.lit(" ")))


def good_label(c) -> Column:
    """The label gate."""
    return _col(c).rlike(r"^[a-z][a-z '\-]{2,24}$")


def good_triple(s, p, o) -> Column:
    """No escaped non-ASCII, no place id as subject, no capitalised run that names an entity."""
    return ~F.concat_ws(" ", _col(s), _col(p), _col(o)).rlike(r"\\u[0-9A-Fa-f]{4}|%[89A-Fa-f][0-9A-Fa-f]") & ~_col(s).rlike(r"--\d+>?$") & ~local_name(_col(s)).rlike(r"^[A-Z][a-z]+_[A-Z]")


def camel_words(c) -> Column:
    """Lower-case words of a camel-case name; dots, underscores and hyphens are spaces."""
    t = F.regexp_replace(_col(c), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.lower(strip(F.regexp_replace(t, r"[._\-\s]+", " ")))


def fragment(c) -> Column:
    """A name with all but ASCII letters and digits as underscores."""
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9]", "_")


def category_term(c) -> Column:
    """A resource's term: underscores to spaces, or a space before each capital where there are none; no Category prefix."""
    t = _col(c)
    t = F.when(t.contains("_"), F.replace(t, F.lit("_"), F.lit(" "))).otherwise(F.regexp_replace(t, r"(?<=.)(?=[A-Z])", " "))
    for gone in ("Category:", '"', " ."):
        t = F.replace(t, F.lit(gone), F.lit(""))
    return t


def class_of_file(path, trim: bool = False) -> Column:
    """Class name of a file name, each word capitalised, WH in capitals; trim drops the last character."""
    stem = F.substring_index(F.substring_index(_col(path), "/", -1), ".", 1)
    words = F.transform(F.split(stem, "_"), lambda w: F.when(F.upper(w) == "WH", "WH").otherwise(F.initcap(w)))
    name = F.array_join(words, "")
    return F.substring(name, F.lit(1), F.greatest(F.length(name) - 1, F.lit(0))) if trim else name


def clean_term(c) -> Column:
    """P25: percent-decoded, digits off the end."""
    return F.regexp_replace(percent_unquote(c), r"\d+$", "")


def verbalise(s, p, o) -> Column:
    """A sentence of a triple; a relation without a template is split at capitals."""
    a, b = (F.replace(_col(x), F.lit("_"), F.lit(" ")) for x in (s, o))
    template = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])[_col(p)]
    plain = F.concat_ws(" ", a, F.lower(F.trim(F.regexp_replace(_col(p), "([A-Z])", " $1"))), b)
    return F.when(template.isNull(), plain).otherwise(F.replace(F.replace(template, F.lit("{s}"), a), F.lit("{o}"), b))


def canonical_triple(s, p, o, indexed: list[str] | None = None) -> dict[str, Column]:
    """P20: canonical subject, predicate and object for graph diffs.

    Blank nodes become one, predicates and the subjects named in `indexed` lose their number, doubles that are whole
    numbers lose their fraction, the string datatype is dropped, and ends of symmetric relations are put in order.
    """
    s, p, o = _col(s), _col(p), _col(o)
    s = F.when(s.startswith("_:"), "_:bnode").otherwise(s)
    o = F.when(o.startswith("_:"), "_:bnode").otherwise(o)
    if indexed:
        bare = F.regexp_replace(s, r"\d+>$", ">")
        name = F.regexp_extract(bare, r"([^/#<]*)>$", 1)
        s = F.when(s.startswith("<") & s.endswith(">") & name.isin(indexed), bare).otherwise(s)
    p = base_relation(p)
    lexical = F.regexp_extract(o, r'^"([^"]+)"\^\^', 1)
    value = lexical.try_cast("double") if hasattr(lexical, "try_cast") else lexical.cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    number = F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    floats = o.endswith(f"^^<{_XSD}double>") | o.endswith(f"^^<{_XSD}float>")
    o = F.when(floats & value.isNotNull(), F.concat(F.lit('"'), number, F.lit('"^^'), F.regexp_extract(o, r"\^\^(.*)$", 1))).otherwise(o)
    o = F.regexp_replace(o, r"\^\^<http://www\.w3\.org/2001/XMLSchema#string>$", "")
    symmetric = p.isin("eq", "<eq>") | p.endswith("/eq>") | p.endswith("#eq>") | F.lower(p).contains("sameas")
    return {"s": F.when(symmetric, F.least(s, o)).otherwise(s), "p": p, "o": F.when(symmetric, F.greatest(s, o)).otherwise(o)}
