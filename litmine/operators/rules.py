"""Rule packs: what an identifier looks like and which contexts decide its class."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """One context class. ``literals`` are plain strings of which a hit must contain one (cheap guard)."""

    name: str
    pattern: str
    literals: tuple[str, ...] = ()
    positive: bool = True
    unless: str | None = None


@dataclass(frozen=True)
class RulePack:
    """Identifier pattern plus ordered context rules; the first rule that fires gives the class.

    ``prefilter`` holds ``(literal, pattern)`` pairs: a text may hold an id if one of the patterns is found,
    and a pattern is only tried on a text with its literal.
    """

    name: str
    id_pattern: str
    prefilter: tuple[tuple[str, str], ...]
    rules: tuple[Rule, ...]
    default: str
    extra_ids: tuple[tuple[str, str], ...] = field(default=())
    upper: bool = True


# Identifier pattern, context patterns and class names, in the order they are tried.
_REST = "(?:[A-Z0-9]{3}|[a-z0-9]{3})"
_ID = f"[1-9]{_REST}"
_DOI = "10.2210/pdb"
_FOUR_DIGITS = r"\d{4}"
# The same strings in the same order of preference as ``\w+\W*\w+``, but a run of word characters is not split in every
# way, so that a long run takes linear time.
_TWO_WORDS = r"(?:\w+\W+\w+|\w\w+)"

PDB = RulePack(
    name="pdb",
    # The tests on what stands before come after the first digit, so that most places fail on one character.
    id_pattern=rf"[1-9](?<=\b\d)(?<![.·]\d)(?!\d{{3}}\b){_REST}\b",
    prefilter=(("", rf"[1-9](?<=\b\d)(?!\d{{3}}\b){_REST}\b"), (_DOI, rf"{_DOI}{_ID}/pdb")),
    extra_ids=((_DOI, rf"{_DOI}({_ID})/pdb"),),
    default="PDB_NONE",
    rules=(
        Rule("PDB_DOI", rf"{_DOI}{_ID}/pdb", (_DOI,)),
        Rule(
            "PDB_ID",
            rf"\b(?:PDB ID:|pdb id:|PDBID|pdbid|PDB_ID|pdb_id).{_ID}\b",
            ("PDB ID:", "pdb id:", "PDBID", "pdbid", "PDB_ID", "pdb_id"),
            unless=_FOUR_DIGITS,
        ),
        Rule("PDB_ENTRY", rf"\b{_ID}entry\b", ("entry",), unless=_FOUR_DIGITS),
        Rule("PDB_FILE", rf"\b{_ID}.pdb\b", ("pdb",), unless=_FOUR_DIGITS),
        Rule("RCSB_PDB_URL1", rf"explore.do.structureId={_ID}\b", ("structureId=",), unless=_FOUR_DIGITS),
        Rule("RCSB_PDB_URL2", rf"explore.cgi.pdbId={_ID}\b", ("pdbId=",), unless=_FOUR_DIGITS),
        Rule("RCSB_PDB_URL3", rf"structidSearch.do.structureId={_ID}\b", ("structureId=",), unless=_FOUR_DIGITS),
        Rule(
            "PDB_EXT_LINK",
            rf'ext-link-type="pdb" xlink:href="{_ID}">',
            ('ext-link-type="pdb"',),
            unless=_FOUR_DIGITS,
        ),
        Rule("PDB_SKIP_0", rf"\b(?:pdb|PDB)\W*{_ID}\b", ("pdb", "PDB"), unless=_FOUR_DIGITS),
        Rule("PDB_SKIP_1", rf"\b(?:pdb|PDB)\W*\w+\W*{_ID}\b", ("pdb", "PDB"), unless=_FOUR_DIGITS),
        Rule("PDB_SKIP_2", rf"\b(?:pdb|PDB)\W*{_TWO_WORDS}\W*{_ID}\b", ("pdb", "PDB"), unless=_FOUR_DIGITS),
        Rule("ACCESSION_SKIP_0", rf"\b(?:accession|Accession)\W*{_ID}\b", ("ccession",), unless=_FOUR_DIGITS),
        Rule("ACCESSION_SKIP_1", rf"\b(?:accession|Accession)\W*\w+\W*{_ID}\b", ("ccession",), unless=_FOUR_DIGITS),
        Rule(
            "ACCESSION_SKIP_2",
            rf"\b(?:accession|Accession)\W*{_TWO_WORDS}\W*{_ID}\b",
            ("ccession",),
            unless=_FOUR_DIGITS,
        ),
    ),
)

# Loose id shape for the known-id filter: a bare id, or one glued to the resource name.
LOOSE_ID = r"((?:\b|pdb|PDB)[1-9][A-Za-z0-9]{3})\b"

# Second pack for general documents: contact data and licence lines.
_MAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
_IPV4 = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
_PHONE = r"\+?\d[\d() -]{7,}\d"
_LICENCE = "(?i:licen[sc]e)"

CONTACT = RulePack(
    name="contact",
    id_pattern=f"{_MAIL}|{_IPV4}|{_PHONE}|{_LICENCE}",
    # Finds a hit exactly if the id pattern does, but starts at one character instead of a whole word.
    prefilter=(
        ("@", r"[\w.+-]@[\w-]+\.[\w.]"),
        ("", r"\d(?:(?<=\b\d)\d{0,2}(?:\.\d{1,3}){3}\b|[\d() -]{7,}\d)"),
        ("", "[Ll](?i:icen[sc]e)"),
    ),
    default="NONE",
    upper=False,
    rules=(
        Rule("EMAIL", _MAIL, ("@",)),
        Rule("IPV4", _IPV4, (".",)),
        Rule("PHONE", _PHONE),
        Rule("LICENCE", _LICENCE),
    ),
)
