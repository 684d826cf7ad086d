"""The cascade of filters over batches of reads.

What differs from read to read (slices, qualities, counts of N) is worked out for a whole batch at once; what depends on a
sequence alone (nearest reference, mismatches, names) once for each distinct sequence, by `reads`. Only primers, whose place
differs from read to read, and overlaps of mates are looked at read by read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..spec import DigestSpec
from .reads import FILTERS, QUALITY_OFFSET, Cutter, Digester, Variant, merge_pair, reverse_complement

TEXT = ["failure", "name", "sequence", "umi", "lengths", "base", "codon", "base_hgvs", "aa", "aa_hgvs", "sequence_aa"]
COUNTS = ["n_bases", "n_codons", "n_aas"]
CONST = ["const_f", "const_f_qual", "const_f_ref", "const_r", "const_r_qual", "const_r_ref"]
KIND = {c: pa.string() for c in (*TEXT, *CONST)} | {c: pa.int32() for c in COUNTS} | {"types": pa.list_(pa.string())}
CODE = {f: i + 1 for i, f in enumerate(FILTERS)}


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and where each begins (and the last ends)."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at.astype(np.int64)


def per_value(strings: pa.Array, fn, kind: pa.DataType) -> pa.Array:
    """fn of each string, called once for each distinct one."""
    coded = strings.dictionary_encode()
    return pa.array([fn(x) for x in coded.dictionary.to_pylist()], kind).take(coded.indices)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], and so on."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


@dataclass
class Columns:
    """The parts of a batch of reads; lengths of the variable segments as text; failure as a code, 0 for none."""

    umi: pa.Array
    var: pa.Array
    var_qual: pa.Array
    const: pa.Array
    const_qual: pa.Array
    lengths: pa.Array
    failure: np.ndarray


def cut(cutter: Cutter, seq: pa.Array, qual: pa.Array) -> Columns:
    if cutter.primers is not None:
        found = [cutter.cut(s, q) for s, q in zip(seq.to_pylist(), qual.to_pylist(), strict=True)]
        text = lambda k: pa.array([getattr(p, k) for p in found], pa.string())
        return Columns(*(text(k) for k in ("umi", "var", "var_qual", "const", "const_qual")), pa.array([",".join(map(str, p.lengths)) for p in found], pa.string()), np.array([CODE.get(p.failure, 0) for p in found], np.int8))
    size = pc.binary_length(seq).to_numpy(zero_copy_only=False)
    made: list[list[pa.Array]] = []
    order, codes = [], []
    for n in np.unique(size).tolist():  # reads of one length are cut alike
        rows = np.flatnonzero(size == n)
        s, q = (seq, qual) if len(rows) == len(seq) else (x.take(pa.array(rows)) for x in (seq, qual))
        plan = cutter.plans[0](n)
        none = pa.array([""], pa.string()).take(pa.array(np.zeros(len(rows), np.int64)))

        def joined(kind: str, x: pa.Array, plan=plan, none=none) -> pa.Array:
            pieces = [pc.utf8_slice_codeunits(x, a, b) for e, a, b in plan or () if e == kind]
            return none if not pieces else pieces[0] if len(pieces) == 1 else pc.binary_join_element_wise(*pieces, "")

        lengths = ",".join(str(b - a) for e, a, b in plan or () if e == "V")
        made.append([joined("U", s), joined("V", s), joined("V", q), joined("C", s), joined("C", q), pa.array([lengths], pa.string()).take(pa.array(np.zeros(len(rows), np.int64)))])
        order.append(rows)
        codes.append(np.full(len(rows), CODE["f3_nbrReadWrongLength"] if plan is None else 0, np.int8))
    if not made:
        empty = pa.array([], pa.string())
        return Columns(*[empty] * 6, np.zeros(0, np.int8))
    if len(made) == 1:
        return Columns(*made[0], codes[0])
    back = np.argsort(np.concatenate(order), kind="stable")
    return Columns(*(pa.concat_arrays(x).take(pa.array(back)) for x in zip(*made, strict=True)), np.concatenate(codes)[back])


def turned(p: Columns) -> Columns:
    """The parts on the other strand; UMIs stay as they were read."""
    complement = lambda x: per_value(x, reverse_complement, pa.string())
    lengths = per_value(p.lengths, lambda x: ",".join(x.split(",")[::-1]), pa.string())
    return Columns(p.umi, complement(p.var), pc.ascii_reverse(p.var_qual), complement(p.const), pc.ascii_reverse(p.const_qual), lengths, p.failure)


def chosen(p: Columns, rows: pa.Array) -> Columns:
    return Columns(*(x.take(rows) for x in (p.umi, p.var, p.var_qual, p.const, p.const_qual, p.lengths)), p.failure[rows.to_numpy()])


class BatchDigester:
    """The outcome of the cascade for batches of reads, as Digester.read() has it for one."""

    def __init__(self, spec: DigestSpec):
        self.spec, self.one = spec, Digester(spec)
        self.known = any(c.seqs for c in self.one.comparers[: 2 if spec.paired and not spec.mergeForwardReverse else 1])

    def read(self, seq1: pa.Array, qual1: pa.Array, seq2: pa.Array | None = None, qual2: pa.Array | None = None) -> dict[str, pa.Array]:
        s, one = self.spec, self.one
        paired = seq2 is not None
        n = len(seq1)
        for seq, qual in ((seq1, qual1), (seq2, qual2)):
            if seq is not None and pc.any(pc.less(pc.fill_null(pc.binary_length(qual), 0), pc.binary_length(seq))).as_py():
                raise ValueError("a read has fewer qualities than bases")
        failure = np.zeros(n, np.int8)

        def fails(rows: np.ndarray, bad: np.ndarray, code: int | np.ndarray) -> None:
            at = rows[bad]
            failure[at] = code[bad] if isinstance(code, np.ndarray) else code

        alive = lambda: np.flatnonzero(failure == 0)
        for seq, adapter in ((seq1, s.adapterForward), (seq2, s.adapterReverse)):
            if seq is not None and adapter:
                failure[pc.match_substring(seq, adapter).to_numpy(zero_copy_only=False)] = CODE["f1_nbrAdapter"]
        rows = alive()
        mates = []
        for k, (seq, qual, turn) in enumerate(((seq1, qual1, s.revComplForward), (seq2, qual2, s.revComplReverse))):
            if seq is None:
                continue
            at = pa.array(rows)
            p = cut(one.cutters[k], seq.take(at), qual.take(at))
            fails(rows, p.failure > 0, p.failure)
            ok = np.flatnonzero(p.failure == 0)
            mates = [chosen(x, pa.array(ok)) for x in (*mates, p)]
            rows = rows[ok]
            if turn:
                mates[-1] = turned(mates[-1])
        f, r = mates[0], mates[1] if paired else None
        if s.mergeForwardReverse:
            split = lambda x: [int(v) for v in x.split(",") if v]
            lists = [c.to_pylist() for c in (f.var, f.var_qual, r.var, r.var_qual, f.lengths, r.lengths)]
            found = [merge_pair(a, b, c, d, split(e), split(g), int(s.minOverlap), int(s.maxOverlap), int(s.minMergedLength), int(s.maxMergedLength), s.maxFracMismatchOverlap, s.greedyOverlap) for a, b, c, d, e, g in zip(*lists, strict=True)]
            fails(rows, np.array([m is None for m in found], bool), CODE["f4_nbrNoValidOverlap"])
            ok = np.array([i for i, m in enumerate(found) if m is not None], np.int64)
            f, r, rows = chosen(f, pa.array(ok)), chosen(r, pa.array(ok)), rows[ok]
            got = [m for m in found if m is not None]
            f.var, f.var_qual, f.lengths = (pa.array(x, pa.string()) for x in ([m[0] for m in got], [m[1] for m in got], [",".join(map(str, m[2])) for m in got]))
        both = [(f, s.avePhredMinForward, s.variableNMaxForward, s.mutatedPhredMinForward)] + ([(r, s.avePhredMinReverse, s.variableNMaxReverse, s.mutatedPhredMinReverse)] if paired and not s.mergeForwardReverse else [])
        for p, least, _, _ in both:
            data, at = flat(p.var_qual)
            total = np.append(0, np.cumsum(data[: at[-1]], dtype=np.int64))
            low = total[at[1:]] - total[at[:-1]] - QUALITY_OFFSET * np.diff(at) < least * pc.binary_length(p.var).to_numpy(zero_copy_only=False)
            fails(rows, low & (failure[rows] == 0), CODE["f5_nbrAvgVarQualTooLow"])
        for p, _, most, _ in both:
            fails(rows, (pc.count_substring(p.var, "N").to_numpy(zero_copy_only=False) > most) & (failure[rows] == 0), CODE["f6_nbrTooManyNinVar"])
        umi = pc.binary_join_element_wise(f.umi, r.umi, "") if paired else f.umi
        fails(rows, (pc.count_substring(umi, "N").to_numpy(zero_copy_only=False) > s.umiNMax) & (failure[rows] == 0), CODE["f7_nbrTooManyNinUMI"])
        keep = np.flatnonzero(failure[rows] == 0)
        rows, umi, f, r = rows[keep], umi.take(pa.array(keep)), chosen(f, pa.array(keep)), chosen(r, pa.array(keep)) if paired else None
        variants: list[list[Variant]] = []
        numbers: list[np.ndarray] = []
        for k, (p, (_, _, _, least)) in enumerate(zip((f, r), both, strict=False)):
            coded = p.var.dictionary_encode()
            vs = [one.comparers[k].of(x) for x in coded.dictionary.to_pylist()]
            at = coded.indices.to_numpy(zero_copy_only=False)
            code = np.array([CODE.get(v.failure, 0) for v in vs], np.int8)[at]
            fails(rows, (code > 0) & (failure[rows] == 0), code)
            if least > 0:
                count = np.array([len(v.mismatches) for v in vs], np.int64)
                places = np.array([i for v in vs for i in v.mismatches], np.int64)
                first = (np.cumsum(count) - count)[at]
                data, begin = flat(p.var_qual)
                owner = np.repeat(np.arange(len(at)), count[at])
                where = np.repeat(begin[:-1], count[at]) + places[spread(first, count[at])]
                low = np.zeros(len(at), bool)
                low[owner[data[where].astype(np.int64) - QUALITY_OFFSET < least]] = True
                fails(rows, low & (failure[rows] == 0), CODE["f9_nbrMutQualTooLow"])
            code = np.array([CODE.get(v.after_quality, 0) for v in vs], np.int8)[at]
            fails(rows, (code > 0) & (failure[rows] == 0), code)
            variants.append(vs)
            numbers.append(at)
        refs = []
        for p, matcher in zip((f, r) if paired else (f,), one.constants, strict=False):
            coded = p.const.dictionary_encode()
            found = [matcher.of(x) for x in coded.dictionary.to_pylist()]
            at = coded.indices.to_numpy(zero_copy_only=False)
            code = np.array([CODE.get(x, 0) for x, _ in found], np.int8)[at]
            fails(rows, (code > 0) & (failure[rows] == 0), code)
            refs.append(pa.array([x for _, x in found], pa.string()).take(coded.indices))
        return self._outcome(failure, rows, umi, f, r, variants, numbers, refs)

    def _outcome(self, failure: np.ndarray, rows: np.ndarray, umi: pa.Array, f: Columns, r: Columns | None, variants: list[list[Variant]], numbers: list[np.ndarray], refs: list[pa.Array]) -> dict[str, pa.Array]:
        keep = pa.array(np.flatnonzero(failure[rows] == 0))
        kept = rows[keep.to_numpy()]
        f, r = chosen(f, keep), chosen(r, keep) if r is not None else None
        refs = [x.take(keep) for x in refs]
        numbers = [x[keep.to_numpy()] for x in numbers]
        pair = numbers[0] if len(numbers) == 1 else numbers[0] * len(variants[1]) + numbers[1]
        pairs, at = np.unique(pair, return_inverse=True)
        own = [(variants[0][i],) for i in pairs.tolist()] if len(numbers) == 1 else [(variants[0][i // len(variants[1])], variants[1][i % len(variants[1])]) for i in pairs.tolist()]
        at = pa.array(at)
        join = lambda vs, k: "_".join(x for x in (getattr(v, k) for v in vs) if x)
        none = "WT" if self.known else ""
        out = {k: pa.array([join(vs, k) or none for vs in own], pa.string()).take(at) for k in ("name", "base", "codon", "aa")}
        out |= {k: pa.array([join(vs, k) for vs in own], pa.string()).take(at) for k in ("base_hgvs", "aa_hgvs")}
        out |= {k: pa.array([sum(getattr(v, k) for v in vs) for vs in own], pa.int32()).take(at) for k in COUNTS}
        out["types"] = pa.array([sorted(frozenset().union(*(v.types for v in vs))) for vs in own], KIND["types"]).take(at)
        two = len(numbers) == 2
        out["sequence"] = pc.binary_join_element_wise(f.var, r.var, "_") if two else f.var
        out["lengths"] = pc.binary_join_element_wise(f.lengths, r.lengths, "_") if two else f.lengths
        out["umi"] = umi.take(keep)
        out["sequence_aa"] = per_value(out["sequence"], self.one.translate, pa.string())
        for side, p, ref in zip("fr", (f, r), refs, strict=False):
            has = pc.not_equal(ref, "")
            out |= {f"const_{side}": pc.if_else(has, p.const, ""), f"const_{side}_qual": pc.if_else(has, p.const_qual, ""), f"const_{side}_ref": ref}
        n = len(failure)
        place = np.full(n, -1)
        place[kept] = np.arange(len(kept))
        place = pa.array(place, mask=place < 0)
        done = {k: x.take(place) for k, x in out.items()}
        done |= {k: pa.nulls(n, pa.string()) for k in CONST if k not in done}
        done = {k: x if k == "types" else pc.fill_null(x, 0 if k in COUNTS else "") for k, x in done.items()}
        done["failure"] = pa.array(["", *FILTERS], pa.string()).take(pa.array(failure))
        return done
