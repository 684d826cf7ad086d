"""The per-read algebra: cutting reads, merging mates, naming variants, and one cascade of filters.

A read is counted by the first filter that it fails, in a fixed order across both mates, so all filters are one function
here. Everything that depends on a sequence alone (nearest reference, mismatches, names) is kept in a bounded cache per
worker: reads of a variant repeat, so most reads cost a few slices and look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from ..functions.genetics import CODE, THREE
from ..spec import DigestSpec, expand_iupac

QUALITY_OFFSET = 33
#: Counters in the order in which they are reported (fixed names).
FILTERS = ["f1_nbrAdapter", "f2_nbrNoPrimer", "f3_nbrReadWrongLength", "f4_nbrNoValidOverlap", "f5_nbrAvgVarQualTooLow", "f6_nbrTooManyNinVar", "f7_nbrTooManyNinUMI", "f8_nbrTooManyBestWTHits", "f9_nbrMutQualTooLow", "f10a_nbrTooManyMutCodons", "f10b_nbrTooManyMutBases", "f11_nbrForbiddenCodons", "f12_nbrTooManyMutConstant", "f13_nbrTooManyBestConstantHits"]
#: What a filtered read's header says (fixed values).
LABELS = dict(zip(FILTERS, ["adapter", "noPrimer_readWrongLength", "noPrimer_readWrongLength", "noValidOverlap", "avgVarQualTooLow", "tooManyNinVar", "tooManyNinUMI", "tooManyBestWTHits", *["mutQualTooLow_tooManyMutCodons_forbiddenCodons"] * 4, "tooManyMutConstant", "tooManyBestConstantHits"], strict=True))
COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANTGCAN")


def reverse_complement(seq: str) -> str:
    if seq.strip("ACGTNacgtn"):
        raise ValueError(f"only ACGTN can be complemented: {seq!r}")
    return seq.translate(COMPLEMENT)[::-1]


def translate(seq: str) -> str:
    """Protein of DNA or RNA; parts between underscores each start a new frame, a partial codon at an end is dropped."""
    return "_".join("".join(CODE.get(p[i : i + 3].upper().replace("U", "T"), "X") for i in range(0, len(p) - 2, 3)) for p in seq.split("_"))


@dataclass
class Parts:
    """What decomposing a read gives; failure names a filter."""

    umi: str = ""
    var: str = ""
    var_qual: str = ""
    lengths: list[int] = field(default_factory=list)
    const: str = ""
    const_qual: str = ""
    failure: str = ""


class Cutter:
    """Cuts a read into its elements; the slices for each read length are worked out once."""

    def __init__(self, elements: str, lengths: list[int], primers: list[str]):
        at = elements.find("P")
        self.primers = primers if at >= 0 else None
        before, after = (elements[:at], elements[at + 1 :]) if at >= 0 else (elements, "")
        self.plans = [lru_cache(None)(lambda n, e=e, ls=ls: self._plan(e, ls, n)) for e, ls in ((before, lengths[: len(before)]), (after, lengths[at + 1 :] if at >= 0 else []))]

    @staticmethod
    def _plan(elements: str, lengths: list[int], n: int) -> list[tuple[str, int, int]] | None:
        """Slices for a part of n bases, or None where it has the wrong length; without elements any length will do."""
        if not elements:
            return []
        fixed = sum(x for x in lengths if x != -1)
        if fixed > n or (-1 not in lengths and fixed != n):
            return None
        out, at = [], 0
        for e, x in zip(elements, lengths, strict=True):
            end = at + (n - fixed if x == -1 else x)
            out.append((e, at, end))
            at = end
        return out

    def cut(self, seq: str, qual: str) -> Parts:
        if self.primers is None:
            found = [(self.plans[0](len(seq)), 0)]
        else:
            for p in self.primers:
                at = seq.find(p)
                if at >= 0:
                    end = at + len(p)
                    found = [(self.plans[0](at), 0), (self.plans[1](len(seq) - end), end)]
                    break
            else:
                return Parts(failure="f2_nbrNoPrimer")
        out = Parts()
        for plan, shift in found:
            if plan is None:
                return Parts(failure="f3_nbrReadWrongLength")
            for e, a, b in plan:
                a, b = a + shift, b + shift
                if e == "V":
                    out.var += seq[a:b]
                    out.var_qual += qual[a:b]
                    out.lengths.append(b - a)
                elif e == "U":
                    out.umi += seq[a:b]
                elif e == "C":
                    out.const += seq[a:b]
                    out.const_qual += qual[a:b]
        return out

    def turned(self, p: Parts) -> Parts:
        """The parts on the other strand; the UMI stays as it was read."""
        return Parts(p.umi, reverse_complement(p.var), p.var_qual[::-1], p.lengths[::-1], reverse_complement(p.const), p.const_qual[::-1])


def find_overlap(f: str, r: str, least: int, most: int, max_frac: float, greedy: bool) -> int:
    """The number of bases by which the end of f overlaps the start of r; 0 if no overlap is valid. N matches all."""
    a, b = np.frombuffer(f.encode(), np.uint8), np.frombuffer(r.encode(), np.uint8)
    best, best_score = 0, -1
    for n in range(most, max(least, 1) - 1, -1):
        x, y = a[len(a) - n :], b[:n]
        score = int(((x == y) | (x == 78) | (y == 78)).sum())
        if (n - score) / n <= max_frac and score > best_score:
            best, best_score = n, score
            if greedy:
                break
    return best


def merge_lengths(f: list[int], r: list[int], len_f: int, overlap: int) -> list[int] | None:
    """Segment lengths of merged reads, or None if breaks between segments inside the overlap don't coincide.

    Breaks are places in the merged read; within the overlap both reads must have the same ones.
    """
    first = len_f - overlap
    breaks_f = np.cumsum(f).tolist()
    breaks_r = (first + np.cumsum(r)).tolist()
    inside_f = [x for x in breaks_f if first < x < len_f]
    inside_r = [x for x in breaks_r if x < len_f]
    if inside_f != inside_r:
        return None
    kept = [n for n, x in zip(f, breaks_f, strict=True) if x <= first]
    return [*kept, r[0] + first - sum(kept), *r[1:]]


def merge_pair(f: str, fq: str, r: str, rq: str, f_lengths: list[int], r_lengths: list[int], min_overlap: int = 0, max_overlap: int = 0, min_merged: int = 0, max_merged: int = 0, max_frac: float = 0, greedy: bool = True) -> tuple[str, str, list[int]] | None:
    """The merged sequence, qualities and segment lengths; None if there is no valid overlap."""
    len_f, len_r = len(f), len(r)
    total, shorter, longer = len_f + len_r, min(len_f, len_r), max(len_f, len_r)
    least = max(min_overlap or shorter, total - min(max_merged or total, total))
    smallest = min_merged or longer
    most = min(max_overlap or shorter, max(0, total - smallest), shorter)
    if least > shorter or smallest > total or most < least:
        return None
    n = find_overlap(f, r, least, most, max_frac, greedy)
    lengths = merge_lengths(f_lengths, r_lengths, len_f, n) if n else None
    if lengths is None:
        return None
    first = len_f - n
    pick = [(rb, rc) if rc > fc else (fb, fc) for fb, fc, rb, rc in zip(f[first:], fq[first:], r, rq, strict=False)]
    return f[:first] + "".join(b for b, _ in pick) + r[n:], fq[:first] + "".join(q for _, q in pick) + rq[n:], lengths


def nearest(seq: str, refs: list[str], bound: int) -> int:
    """Number of the reference with the most matches among those within the bound of mismatches; -1 none, -2 a tie."""
    best, most, ties = -1, -1, 0
    for i, ref in enumerate(refs):
        same = sum(map(str.__eq__, seq, ref))
        if len(seq) - same <= bound:
            if same == most:
                ties += 1
            elif same > most:
                best, most, ties = i, same, 1
    return -2 if ties > 1 else best


class ReferenceIndex:
    """Many references of which a sequence has few neighbours: within the bound of mismatches, and so in one of bound + 1 blocks,
    it must agree with a reference of its length. Only those are compared. References of other lengths, or without any match,
    are no neighbours here; equal references count once, as the last of them."""

    def __init__(self, refs: list[str], bound: int):
        self.bound, self.exact = bound, {r: i for i, r in enumerate(refs)}
        self.blocks: dict[tuple[int, int, str], list[int]] = {}
        self.bytes = {i: np.frombuffer(r.encode(), np.uint8) for r, i in self.exact.items()}
        for r, i in self.exact.items():
            for at, piece in self.pieces(r):
                self.blocks.setdefault((len(r), at, piece), []).append(i)

    def pieces(self, seq: str) -> list[tuple[int, str]]:
        """Where each block of a sequence begins, and the block."""
        n = min(self.bound + 1, len(seq))
        cuts = [len(seq) * i // n for i in range(n + 1)] if n else []
        return [(a, seq[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def nearest(self, seq: str) -> int:
        """As nearest: -1 none, -2 a tie."""
        if seq in self.exact and seq and self.bound >= 0:
            return self.exact[seq]
        near = sorted({i for at, piece in self.pieces(seq) for i in self.blocks.get((len(seq), at, piece), ())})
        if not near:
            return -1
        d = (np.stack([self.bytes[i] for i in near]) != np.frombuffer(seq.encode(), np.uint8)).sum(1)
        least = d.min()
        if least > self.bound:
            return -1
        return -2 if (d == least).sum() > 1 else near[int(d.argmin())]


def base_hgvs(positions: list[int], ref: str, var: str) -> str:
    """HGVS of base changes at 1-based positions: those at most two apart are one deletion-insertion."""
    groups: list[list[int]] = []
    for p in positions:
        if groups and p - groups[-1][1] <= 2:
            groups[-1][1] = p
        else:
            groups.append([p, p])
    ids = [f"{a}{ref[a - 1]}>{var[a - 1]}" if a == b else f"{a}_{b}delins{var[a - 1 : b]}" for a, b in groups]
    return f"[{';'.join(ids)}]" if len(ids) > 1 else "".join(ids)


def aa_hgvs(changes: list[tuple[int, str]], ref_protein: str) -> str:
    """HGVS of amino acid changes: (1-based position, one-letter code)."""
    ids = [f"({THREE.get(ref_protein[p - 1], '')}{p}{THREE.get(a, '')})" for p, a in changes]
    return f"[{';'.join(ids)}]" if len(ids) > 1 else "".join(ids)


@dataclass(frozen=True)
class Variant:
    """What a variable sequence is, next to its reference: all but the qualities of a read."""

    failure: str = ""
    mismatches: tuple[int, ...] = ()
    after_quality: str = ""  # a filter that comes after the quality of the mismatches
    name: str = ""
    base: str = ""
    codon: str = ""
    aa: str = ""
    base_hgvs: str = ""
    aa_hgvs: str = ""
    n_bases: int = 0
    n_codons: int = 0
    n_aas: int = 0
    types: frozenset[str] = frozenset()


class Comparer:
    """Names sequences by their nearest reference."""

    def __init__(self, refs: dict[str, str], codons_max: int, bases_max: int, forbidden: list[str], delimiter: str, collapse: bool, cache: int = 200_000, index: bool = False):
        self.names, self.seqs = list(refs), list(refs.values())
        self.codons_max, self.bases_max, self.delimiter, self.collapse = codons_max, bases_max, delimiter, collapse
        self.bound = 3 * codons_max if codons_max != -1 else bases_max
        self.nearest = ReferenceIndex(self.seqs, self.bound).nearest if index else lambda var: nearest(var, self.seqs, self.bound)
        self.too_many = "f10a_nbrTooManyMutCodons" if codons_max != -1 else "f10b_nbrTooManyMutBases"
        self.forbidden = frozenset(expand_iupac(forbidden))
        self.of = lru_cache(cache)(self._of)

    def _of(self, var: str) -> Variant:
        if not self.seqs:
            return Variant(name=var, base=var, codon=var, aa=translate(var)) if var else Variant()
        at = self.nearest(var)
        if at < 0:
            return Variant(failure=self.too_many if at == -1 else "f8_nbrTooManyBestWTHits")
        ref, name, d = self.seqs[at], self.names[at], self.delimiter
        if len(var) > len(ref):
            return Variant(failure="f3_nbrReadWrongLength")
        diff = [i for i, (x, y) in enumerate(zip(var, ref, strict=False)) if x != y]
        codons = list(dict.fromkeys(i // 3 for i in diff))
        late = ""
        if (len(codons) > self.codons_max) if self.codons_max != -1 else (len(diff) > self.bases_max):
            late = self.too_many
        elif any(var[3 * c : 3 * c + 3] in self.forbidden for c in codons):
            late = "f11_nbrForbiddenCodons"
        if late:
            return Variant(mismatches=tuple(diff), after_quality=late)
        changes, types = [], set()
        for c in codons:
            new, old = translate(var[3 * c : 3 * c + 3]), translate(ref[3 * c : 3 * c + 3])
            if new != old:
                changes.append((c + 1, new))
            types.add("silent" if new == old else "stop" if new == "*" else "nonsynonymous")
        c_name = name if name.endswith(":c") else name + ":c"
        p_name = c_name[:-1] + "p"
        found = dict(mismatches=tuple(diff), n_bases=len(diff), n_codons=len(codons), n_aas=len(changes), types=frozenset(types))
        if self.collapse:
            return Variant(name=name, base=name, codon=name, aa=name, base_hgvs=c_name, aa_hgvs=p_name, **found)
        none = f"{name}{d}0{d}WT"
        join = lambda items: "_".join(f"{name}{d}{p}{d}{x}" for p, x in items) or none
        base = join((i + 1, var[i]) for i in diff)
        codon = join((c + 1, var[3 * c : 3 * c + 3]) for c in codons)
        return Variant(
            name=codon if self.codons_max != -1 else base,
            base=base,
            codon=codon,
            aa=join(changes),
            base_hgvs=c_name + ("." + base_hgvs([i + 1 for i in diff], ref, var) if diff else ""),
            aa_hgvs=p_name + ("." + aa_hgvs(changes, translate(ref)) if changes else ""),
            **found,
        )


class ConstantMatcher:
    def __init__(self, constants: list[str], max_dist: int, cache: int = 50_000):
        self.constants, self.max_dist = constants, max_dist
        self.of = lru_cache(cache)(self._of)

    def _of(self, seq: str) -> tuple[str, str]:
        """The filter that the sequence fails, and the nearest constant sequence."""
        if not self.constants:
            return "", ""
        at = nearest(seq, self.constants, self.max_dist if self.max_dist != -1 else len(seq))
        return ("f12_nbrTooManyMutConstant", "") if at == -1 else ("f13_nbrTooManyBestConstantHits", "") if at == -2 else ("", self.constants[at])


def quality_sum(qual: str) -> int:
    return sum(qual.encode()) - QUALITY_OFFSET * len(qual)


@dataclass
class Read:
    """The outcome for a read: the filter that it fails, or all that is known of its variant."""

    failure: str = ""
    name: str = ""
    sequence: str = ""
    umi: str = ""
    lengths: str = ""
    n_bases: int = 0
    n_codons: int = 0
    n_aas: int = 0
    base: str = ""
    codon: str = ""
    base_hgvs: str = ""
    aa: str = ""
    aa_hgvs: str = ""
    types: tuple[str, ...] = ()
    sequence_aa: str = ""
    const_f: str = ""
    const_f_qual: str = ""
    const_f_ref: str = ""
    const_r: str = ""
    const_r_qual: str = ""
    const_r_ref: str = ""


class Digester:
    """The whole cascade for one specification."""

    def __init__(self, spec: DigestSpec):
        self.spec = s = spec
        side = lambda k: [getattr(s, f"{k}{x}") for x in ("Forward", "Reverse")]
        self.cutters = [Cutter(*x) for x in zip(side("elements"), side("elementLengths"), side("primer"), strict=True)]
        self.comparers = [Comparer(refs, c, b, forbidden, s.mutNameDelimiter, collapse, index=s.useTreeWTmatch) for refs, c, b, forbidden, collapse in zip(side("wildType"), side("nbrMutatedCodonsMax"), side("nbrMutatedBasesMax"), side("forbiddenMutatedCodons"), side("collapseToWT"), strict=True)]
        self.constants = [ConstantMatcher(*x) for x in zip(side("constant"), side("constantMaxDist"), strict=True)]
        self.translate = lru_cache(200_000)(translate)

    def read(self, seq1: str, qual1: str, seq2: str | None = None, qual2: str | None = None) -> Read:
        s = self.spec
        paired = seq2 is not None
        if len(qual1) < len(seq1) or (paired and len(qual2 or "") < len(seq2)):
            raise ValueError("a read has fewer qualities than bases")
        if (s.adapterForward and s.adapterForward in seq1) or (paired and s.adapterReverse and s.adapterReverse in seq2):
            return Read("f1_nbrAdapter")
        f = self.cutters[0].cut(seq1, qual1)
        r = self.cutters[1].cut(seq2, qual2) if paired and not f.failure else Parts()
        if f.failure or r.failure:
            return Read(f.failure or r.failure)
        if s.revComplForward:
            f = self.cutters[0].turned(f)
        if s.revComplReverse and paired:
            r = self.cutters[1].turned(r)
        trans = paired and not s.mergeForwardReverse
        if s.mergeForwardReverse:
            merged = merge_pair(f.var, f.var_qual, r.var, r.var_qual, f.lengths, r.lengths, int(s.minOverlap), int(s.maxOverlap), int(s.minMergedLength), int(s.maxMergedLength), s.maxFracMismatchOverlap, s.greedyOverlap)
            if merged is None:
                return Read("f4_nbrNoValidOverlap")
            f.var, f.var_qual, f.lengths = merged
        mates = [(f, s.avePhredMinForward, s.variableNMaxForward, s.mutatedPhredMinForward)] + ([(r, s.avePhredMinReverse, s.variableNMaxReverse, s.mutatedPhredMinReverse)] if trans else [])
        if any(quality_sum(p.var_qual) < least * len(p.var) for p, least, _, _ in mates):
            return Read("f5_nbrAvgVarQualTooLow")
        if any(p.var.count("N") > most for p, _, most, _ in mates):
            return Read("f6_nbrTooManyNinVar")
        umi = f.umi + r.umi
        if umi.count("N") > s.umiNMax:
            return Read("f7_nbrTooManyNinUMI")
        found = []
        for (p, _, _, least), comparer in zip(mates, self.comparers, strict=False):
            v = comparer.of(p.var)
            if v.failure:
                return Read(v.failure)
            if least > 0 and any(ord(p.var_qual[i]) - QUALITY_OFFSET < least for i in v.mismatches):
                return Read("f9_nbrMutQualTooLow")
            if v.after_quality:
                return Read(v.after_quality)
            found.append(v)
        refs = []
        for p, matcher in zip((f, r) if paired else (f,), self.constants, strict=False):
            failure, ref = matcher.of(p.const)
            if failure:
                return Read(failure)
            refs.append(ref)
        join = lambda k: "_".join(x for x in (getattr(v, k) for v in found) if x)
        sequence = "_".join(p.var for p, *_ in mates)
        known = any(c.seqs for c in self.comparers[: len(mates)])
        names = {k: join(k) or ("WT" if known else "") for k in ("name", "base", "codon", "aa")}
        return Read(
            sequence=sequence,
            umi=umi,
            lengths="_".join(",".join(map(str, p.lengths)) for p, *_ in mates),
            n_bases=sum(v.n_bases for v in found),
            n_codons=sum(v.n_codons for v in found),
            n_aas=sum(v.n_aas for v in found),
            base_hgvs=join("base_hgvs"),
            aa_hgvs=join("aa_hgvs"),
            types=tuple(sorted(frozenset().union(*(v.types for v in found)))),
            sequence_aa=self.translate(sequence),
            const_f=f.const if refs[0] else "",
            const_f_qual=f.const_qual if refs[0] else "",
            const_f_ref=refs[0],
            const_r=r.const if len(refs) > 1 and refs[1] else "",
            const_r_qual=r.const_qual if len(refs) > 1 and refs[1] else "",
            const_r_ref=refs[1] if len(refs) > 1 else "",
            **names,
        )
