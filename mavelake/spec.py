"""The request for one digest: every argument, checked and normalised once, on the driver."""

from __future__ import annotations

import itertools
import os
import re
import warnings
from dataclasses import asdict, dataclass, field, fields

from .checks import assert_scalar, assert_vector

#: Concrete bases of the IUPAC letters (fixed values).
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}
SIDES = ("Forward", "Reverse")


def expand_iupac(patterns: list[str] | str) -> list[str]:
    """All concrete codons of some patterns, sorted; an empty pattern has none."""
    out = set()
    for p in [patterns] if isinstance(patterns, str) else patterns:
        if p:
            out.update("".join(x) for x in itertools.product(*(IUPAC[c] for c in p.upper())))
    return sorted(out)


def _as_list(x) -> list:
    return [] if x is None else list(x.values()) if isinstance(x, dict) else list(x) if isinstance(x, (list, tuple)) else [x]


@dataclass
class DigestSpec:
    """Arguments keep the public names of the assay's read digest, so that existing calls carry over."""

    fastqForward: str | list[str] = ""
    fastqReverse: str | list[str] | None = None
    mergeForwardReverse: bool = False
    minOverlap: int = 0
    maxOverlap: int = 0
    minMergedLength: int = 0
    maxMergedLength: int = 0
    maxFracMismatchOverlap: float = 1
    greedyOverlap: bool = True
    revComplForward: bool = False
    revComplReverse: bool = False
    adapterForward: str = ""
    adapterReverse: str = ""
    elementsForward: str = ""
    elementsReverse: str = ""
    elementLengthsForward: list[int] = field(default_factory=list)
    elementLengthsReverse: list[int] = field(default_factory=list)
    primerForward: str | list[str] = ""
    primerReverse: str | list[str] = ""
    wildTypeForward: str | dict[str, str] = ""
    wildTypeReverse: str | dict[str, str] = ""
    constantForward: str | list[str] = ""
    constantReverse: str | list[str] = ""
    avePhredMinForward: float = 20.0
    avePhredMinReverse: float = 20.0
    variableNMaxForward: int = 0
    variableNMaxReverse: int = 0
    umiNMax: int = 0
    nbrMutatedCodonsMaxForward: int = 1
    nbrMutatedCodonsMaxReverse: int = 1
    nbrMutatedBasesMaxForward: int = -1
    nbrMutatedBasesMaxReverse: int = -1
    forbiddenMutatedCodonsForward: str | list[str] = ""
    forbiddenMutatedCodonsReverse: str | list[str] = ""
    useTreeWTmatch: bool = False
    collapseToWTForward: bool = False
    collapseToWTReverse: bool = False
    mutatedPhredMinForward: float = 0.0
    mutatedPhredMinReverse: float = 0.0
    mutNameDelimiter: str = "."
    constantMaxDistForward: int = -1
    constantMaxDistReverse: int = -1
    umiCollapseMaxDist: float = 0
    filteredReadsFastqForward: str = ""
    filteredReadsFastqReverse: str = ""
    maxNReads: int = -1
    verbose: bool = False
    nThreads: int = 1
    chunkSize: int = 100_000
    maxReadLength: int = 1024

    @classmethod
    def of(cls, _check_files: bool = False, **arguments) -> DigestSpec:
        """Bind arguments; deprecated ones are ignored with a warning."""
        known = {f.name for f in fields(cls)}
        for name in [n for n in arguments if n.startswith("variableCollapse")]:
            warnings.warn(f"The '{name}' argument is deprecated and ignored; use collapse_mutants_by_similarity() instead", DeprecationWarning, stacklevel=2)
            del arguments[name]
        if unknown := set(arguments) - known:
            raise TypeError(f"unused argument(s): {', '.join(sorted(unknown))}")
        spec = cls(**arguments)
        spec._check(_check_files)
        return spec

    def _check(self, check_files: bool) -> None:
        for side in SIDES:
            setattr(self, f"fastq{side}", [x for x in _as_list(getattr(self, f"fastq{side}")) if x])
        if check_files:
            if not self.fastqForward:
                raise ValueError("'fastqForward' must name at least one file")
            for path in (*self.fastqForward, *self.fastqReverse):
                if "://" not in path and not os.path.exists(path):
                    raise FileNotFoundError(f"'{path}' does not exist")
        if self.fastqReverse and len(self.fastqForward) != len(self.fastqReverse):
            raise ValueError("each file of 'fastqForward' needs one of 'fastqReverse'")
        for name in ("mergeForwardReverse", "greedyOverlap", "revComplForward", "revComplReverse", "useTreeWTmatch", "collapseToWTForward", "collapseToWTReverse", "verbose"):
            assert_scalar(getattr(self, name), name, "logical")
        if self.mergeForwardReverse and check_files and not self.fastqReverse:
            raise ValueError("merging mates takes files of both mates")
        inf = float("inf")
        for name in ("minOverlap", "maxOverlap", "minMergedLength", "maxMergedLength", "avePhredMinForward", "avePhredMinReverse", "variableNMaxForward", "variableNMaxReverse", "umiNMax", "mutatedPhredMinForward", "mutatedPhredMinReverse", "umiCollapseMaxDist"):
            assert_scalar(getattr(self, name), name, "numeric", rng_incl=(0, inf))
        assert_scalar(self.maxFracMismatchOverlap, "maxFracMismatchOverlap", "numeric", rng_incl=(0, 1))
        for name in ("nbrMutatedCodonsMaxForward", "nbrMutatedCodonsMaxReverse", "nbrMutatedBasesMaxForward", "nbrMutatedBasesMaxReverse", "constantMaxDistForward", "constantMaxDistReverse"):
            assert_scalar(getattr(self, name), name, "numeric", rng_incl=(0, inf), valid_values=[-1])
        assert_scalar(self.maxNReads, "maxNReads", "numeric", rng_excl=(0, inf), valid_values=[-1])
        for name in ("nThreads", "chunkSize", "maxReadLength"):
            assert_scalar(getattr(self, name), name, "numeric", rng_excl=(0, inf))
        for side in SIDES:
            self._check_side(side)
        if self.mergeForwardReverse and self.wildTypeReverse:
            warnings.warn("mates are merged: 'wildTypeReverse' has no effect", stacklevel=3)
            self.wildTypeReverse = {}
        if self.mergeForwardReverse and any(x for x in self.forbiddenMutatedCodonsReverse):
            warnings.warn("mates are merged: 'forbiddenMutatedCodonsReverse' has no effect", stacklevel=3)
        assert_scalar(self.mutNameDelimiter, "mutNameDelimiter", "character")
        names = [*self.wildTypeForward, *self.wildTypeReverse]
        if len(self.mutNameDelimiter) != 1 or self.mutNameDelimiter == "_":
            raise ValueError("'mutNameDelimiter' takes one character other than '_'")
        if any(self.mutNameDelimiter in n for n in names):
            raise ValueError("a name of 'wildTypeForward' or 'wildTypeReverse' holds 'mutNameDelimiter'")
        for side in SIDES:
            out = getattr(self, f"filteredReadsFastq{side}")
            assert_scalar(out, f"filteredReadsFastq{side}", "character")
            if out and not out.endswith(".gz"):
                raise ValueError(f"'filteredReadsFastq{side}' must end with .gz")
        if check_files and (self.filteredReadsFastqForward or self.filteredReadsFastqReverse) and bool(self.filteredReadsFastqReverse) != bool(self.fastqReverse):
            raise ValueError("name an output of filtered reads for each mate that is read, and no other")

    def _bases(self, name: str, values: list[str]) -> list[str]:
        for v in values:
            if not isinstance(v, str) or not re.fullmatch("[ACGTacgt]*", v):
                raise ValueError(f"'{name}' takes the letters A, C, G and T only")
        return [v.upper() for v in values]

    def _check_side(self, side: str) -> None:
        get = lambda n: getattr(self, n + side)
        put = lambda n, v: setattr(self, n + side, v)
        put("adapter", self._bases(f"adapter{side}", [get("adapter")])[0])
        elements, lengths = get("elements"), [int(x) for x in _as_list(get("elementLengths"))]
        put("elementLengths", lengths)
        assert_scalar(elements, f"elements{side}", "character")
        if not re.fullmatch("[CUSVP]*", elements):
            raise ValueError(f"'elements{side}' takes the letters C, U, S, V and P only")
        if len(elements) != len(lengths):
            raise ValueError(f"'elementLengths{side}' takes one number for each letter of 'elements{side}'")
        assert_vector(lengths, f"elementLengths{side}", "numeric", rng_incl=(0, float("inf")), valid_values=[-1])
        parts = elements.split("P")
        if len(parts) > 2:
            raise ValueError(f"'elements{side}' takes one 'P' at most")
        at = 0
        for part in parts:
            if sum(x == -1 for x in lengths[at : at + len(part)]) > 1:
                raise ValueError(f"more than one -1 on one side of the primer in 'elementLengths{side}'")
            at += len(part) + 1
        put("primer", [p for p in self._bases(f"primer{side}", _as_list(get("primer")))])
        if len(parts) == 2 and not get("primer"):
            put("primer", [""])
        refs = get("wildType")
        if isinstance(refs, str):
            refs = {side[0].lower(): refs} if refs else {}
        if not isinstance(refs, dict) or any(not isinstance(k, str) or not k for k in refs):
            raise ValueError(f"'wildType{side}' must be a string or map names to sequences")
        seqs = self._bases(f"wildType{side}", list(refs.values()))
        if len(set(seqs)) < len(seqs):
            raise ValueError(f"a sequence is twice in 'wildType{side}'")
        put("wildType", dict(zip(refs, seqs, strict=True)))
        if seqs and (get("nbrMutatedCodonsMax") == -1) == (get("nbrMutatedBasesMax") == -1):
            raise ValueError(f"one of 'nbrMutatedCodonsMax{side}' and 'nbrMutatedBasesMax{side}' is to be -1, the other a limit")
        constants = [c for c in self._bases(f"constant{side}", _as_list(get("constant"))) if c]
        if len({len(c) for c in constants}) > 1:
            raise ValueError(f"the sequences of 'constant{side}' differ in length")
        own = [n for e, n in zip(elements, lengths, strict=True) if e == "C"]
        if constants and own and -1 not in own and sum(own) != len(constants[0]):
            raise ValueError(f"'constant{side}' is as long as {len(constants[0])} bases, the C elements of 'elementLengths{side}' as {sum(own)}")
        put("constant", constants)
        codons = [c.upper() for c in _as_list(get("forbiddenMutatedCodons"))]
        if not all(re.fullmatch("[ACGTMRWSYKVHDBN]{3}|", c) for c in codons):
            raise ValueError(f"'forbiddenMutatedCodons{side}' takes codons of three IUPAC letters")
        put("forbiddenMutatedCodons", codons)

    @property
    def paired(self) -> bool:
        return bool(self.fastqReverse) or bool(self.elementsReverse)

    @property
    def trans(self) -> bool:
        """Whether the mates stay apart in the variant's name and sequence."""
        return self.paired and not self.mergeForwardReverse

    def has_component(self, letter: str) -> bool:
        return letter in self.elementsForward or letter in self.elementsReverse

    def parameters(self) -> dict:
        return asdict(self)
