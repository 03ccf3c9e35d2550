"""Column expressions: cleaning, typing and labelling of raw text fields. All stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of the evidence graph.
NODE_TYPES = ("drug", "gene", "phenotype", "variant")
TENSOR_TYPES = ("drug", "gene", "variant", "phenotype")
TYPE_WORDS = {
    "drug": ("chemical", "chemicals", "drug", "compound"),
    "gene": ("gene", "genes"),
    "phenotype": ("phenotype", "phenotypes", "disease", "diseases", "clinical phenotype"),
    "variant": ("variant", "variants"),
}
EVIDENCE_WORDS = (
    ("guideline", ("guideline", "cpic")),
    ("label", ("label", "fda")),
    ("pathway", ("pathway", "reactome")),
    ("clinical", ("clinical", "annotation")),
    ("literature", ("literature", "pmid")),
)
ASSOCIATIONS = ("associated", "ambiguous", "not_associated")
STRATA = ("2", "3-4", "5-9", "10-19", "20+")
EVIDENCE_PRIORITY = {"guideline": 1, "label": 2, "clinical": 3, "literature": 4, "pathway": 5, "other": 6}
NULL_TEXT = ("", "nan", "none", "null")
# Raw types of an audit with their type and subtype.
AUDIT_TYPES = {"Chemical": ("drug", "chemical"), "Gene": ("gene", "gene"), "Disease": ("phenotype", "disease"), "Variant": ("variant", "sequence_variant")}
# Words of split labels, letters only.
SPLIT_WORDS = {
    "train": ("train", "training", "trainset", "trainingset", "trainingcontextonly", "traincontextonly", "traincontext", "trainingcontext"),
    "validation": ("validation", "validate", "valid", "val", "validationset", "valset", "dev"),
    "test": ("test", "testing", "testset", "tst"),
}
# What stands for a missing structure, after white space is dropped, in lower case.
NO_STRUCTURE = ("", "none", "null", "nan", "na", "n/a", "n.a.", "[notavailable]", "notavailable", "unknown", "missing")
# Tokens that a pandas reader takes for missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value: Column | str) -> Column:
    """Trimmed text with single spaces (Unicode white space counts); null for null words and nothing."""
    text = F.trim(F.regexp_replace(as_column(value), r"(?U)\s+", " "))
    return F.when(~F.lower(text).isin(*NULL_TEXT), text)


def null_tokens(value: Column | str) -> Column:
    """Null for the tokens that mean missing in delimited files, else the value as it is."""
    return F.when(~as_column(value).isin(*NA_TOKENS), as_column(value))


def canonical_type(value: Column | str, unknown: str = "null") -> Column:
    """drug, gene, phenotype or variant of a raw type; null for haplotypes, blanks and unknown types.

    unknown="keep" gives unknown types in lower case and haplotypes as variants, as the older schema has it.
    """
    raw = F.lower(clean_text(value))
    out = F.when(raw.isin("haplotype", "haplotypes"), F.lit("variant") if unknown == "keep" else F.lit(None).cast("string"))
    for kind, words in TYPE_WORDS.items():
        out = out.when(raw.isin(*words), kind)
    return out.otherwise(raw) if unknown == "keep" else out


def is_haplotype(value: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(as_column(value))).isin("haplotype", "haplotypes"), F.lit(False))


def normalise_evidence(value: Column | str) -> Column:
    """Evidence category by the first matching group of words; other for null and all else."""
    text = F.lower(F.coalesce(as_column(value), F.lit("")))
    out = None
    for kind, words in EVIDENCE_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")  # type: ignore[union-attr]


def normalise_association(value: Column | str) -> Column:
    """associated, ambiguous or not_associated; null for blanks and other labels (see quality.unknown_labels)."""
    label = F.regexp_replace(F.lower(clean_text(value)), r"[\s-]+", "_")
    return F.when(label.isin(*ASSOCIATIONS), label)


def split_label(label: Column | str) -> Column:
    """train, validation or test of a label however written; training context counts as train; else null."""
    word = F.regexp_replace(F.lower(as_column(label)), r"(?U)[^\p{L}]+", "")
    out = F.when(word.isin(*SPLIT_WORDS["train"]), "train")
    for split in ("validation", "test"):
        out = out.when(word.isin(*SPLIT_WORDS[split]), split)
    return out


def structure(smiles: Column | str) -> Column:
    """The structure without white space (no-break spaces included); null for a placeholder. Every letter of a short one counts too."""
    bare = F.regexp_replace(as_column(smiles), r"(?U)\s+", "")
    return F.when(~(F.lower(bare).isin(*NO_STRUCTURE) | ~bare.rlike("[A-Za-z]")), bare)


def relation_type(source: Column | str, target: Column | str, evidence: Column | str, association: Column | str) -> Column:
    """The four parts with underscores between; null if one is null."""
    parts = [as_column(x) for x in (source, target, evidence, association)]
    return F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2], F.lit("_"), parts[3])


def type_order(kind: Column | str, order: tuple[str, ...] = NODE_TYPES) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in order]), as_column(kind)).cast("int") - 1


def degree_stratum(n: Column | str) -> Column:
    """Stratum label of a positive pair count; null below 2."""
    n = as_column(n)
    return F.when(n >= 20, "20+").when(n >= 10, "10-19").when(n >= 5, "5-9").when(n >= 3, "3-4").when(n == 2, "2")


def degree_group(n: Column | str) -> Column:
    """Display group of a training degree: 0, 1-2, 3-9, 10+."""
    n = as_column(n)
    return F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 9, "3-9").otherwise("10+")


def year_token(value: Column | str) -> Column:
    """First space-separated token of four digits; null if there is none."""
    return F.try_element_at(F.filter(F.split(as_column(value), " "), lambda t: t.rlike("^[0-9]{4}$")), F.lit(1))


def first_sentence(value: Column | str) -> Column:
    """Text up to the first full stop before a space and a capital; the whole text if there is none."""
    whole = as_column(value)
    found = F.regexp_extract(whole, r"(?s)^(.*?\.)\s+\p{Lu}", 1)
    return F.when(found == "", whole).otherwise(found)


def split_symbols(value: Column | str, pattern: str = ",") -> Column:
    """Distinct upper-case symbols of a delimited field, blanks and null words left out."""
    parts = F.transform(F.split(as_column(value), pattern), lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: ~F.lower(x).isin(*NULL_TEXT)))


def author_short(authors: Column | str) -> Column:
    """First author with et al. of a semicolon-separated list of several; null for none."""
    names = F.filter(F.split(as_column(authors), r"\s*;\s*"), lambda x: x != "")
    return F.when(F.size(names) == 1, names[0]).when(F.size(names) > 1, F.concat(names[0], F.lit(" et al.")))


def citation(authors: Column | str, title: Column | str, journal: Column | str, year: Column | str) -> Column:
    """Author (year). Title. Journal. Missing parts are left out."""
    head = F.concat(author_short(authors), F.coalesce(F.concat(F.lit(" ("), as_column(year), F.lit(")")), F.lit("")))
    return F.concat(F.concat_ws(". ", head, as_column(title), as_column(journal)), F.lit("."))


def node_key(kind: Column | str, node_id: Column | str) -> Column:
    """type:id, as maps of nodes are keyed."""
    return F.concat_ws(":", as_column(kind), as_column(node_id))


def source_of(name: Column | str) -> Column:
    """What stands before the first double colon of a set's name; the whole name if there is none."""
    return F.split_part(as_column(name), F.lit("::"), F.lit(1))


def audit_type(value: Column | str) -> Column:
    """The audit's reading of a raw type: by its exact words, all else in lower case; null stays null."""
    return _audited(value, 0)


def audit_subtype(value: Column | str) -> Column:
    """As audit_type, the finer kind."""
    return _audited(value, 1)


def _audited(value: Column | str, place: int) -> Column:
    raw = F.trim(as_column(value))
    words = F.create_map(*[F.lit(x) for word, kinds in AUDIT_TYPES.items() for x in (word, kinds[place])])
    return F.coalesce(words[raw], F.lower(raw))


def title_case(value: Column | str) -> Column:
    """A label with underscores as spaces and capitals at the beginning of words."""
    return F.initcap(F.regexp_replace(as_column(value), "_+", " "))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-as_column(x)))
