import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mavelake.operators import reads as R
from mavelake.operators.cascade import CONST, COUNTS, TEXT, BatchDigester
from mavelake.spec import DigestSpec, expand_iupac

def q(n, v):
    return chr(v + 33) * n


def word(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_cut_puts_together_what_was_joined():
    """Reads are made from known parts, so the parts are what cutting must give back."""
    rng = random.Random(4)
    for _ in range(300):
        kinds = [rng.choice("UCVS") for _ in range(rng.randrange(1, 8))]
        sizes = [rng.randrange(0, 5) for _ in kinds]
        primer = rng.choice(["", "GGTGG"])
        bases = [word(rng, n, "ACT") for n in sizes]  # without G, so the primer is where it was put
        quals = [word(rng, n, "ABCDEFGH") for n in sizes]
        lengths = list(sizes)
        at = rng.randrange(len(kinds) + 1)
        for lo, hi in ((0, at), (at, len(kinds))) if primer else ((0, len(kinds)),):
            if hi > lo and rng.random() < 0.5:
                lengths[rng.randrange(lo, hi)] = -1  # to be worked out
        seq, qual = list(bases), list(quals)
        elements = list(kinds)
        if primer:
            seq.insert(at, primer)
            qual.insert(at, "I" * len(primer))
            elements.insert(at, "P")
            lengths.insert(at, -1)
        p = R.Cutter("".join(elements), lengths, [primer]).cut("".join(seq), "".join(qual))
        of = lambda k, xs: "".join(x for e, x in zip(kinds, xs, strict=True) if e == k)  # noqa: E731, B023
        assert p.failure == ""
        assert (p.umi, p.var, p.var_qual, p.const, p.const_qual) == (of("U", bases), of("V", bases), of("V", quals), of("C", bases), of("C", quals))
        assert p.lengths == [n for e, n in zip(kinds, sizes, strict=True) if e == "V"]


def test_cut_failures():
    read = "CATTAGGTACCA"
    cut = lambda *a: R.Cutter(*a).cut(read, "I" * len(read)).failure
    assert cut("PV", [-1, -1], ["CCCC"]) == "f2_nbrNoPrimer"
    assert cut("UV", [4, 7], [""]) == cut("UV", [13, -1], [""]) == "f3_nbrReadWrongLength"
    # the first primer in the list that occurs decides, even if a later one would fit
    assert cut("UPV", [5, -1, -1], ["TTA", "GGT"]) == "f3_nbrReadWrongLength" and cut("UPV", [5, -1, -1], ["GGT", "TTA"]) == ""


def plain_merge(f, fq, r, rq, least, most, share, greedy):
    """Merged bases and qualities: the longest valid overlap, or the one of most matches (the longest of equals)."""
    valid = []
    for n in range(most, max(1, least) - 1, -1):
        pairs = list(zip(f[len(f) - n :], r[:n], strict=True))
        same = sum(x == y or "N" in (x, y) for x, y in pairs)
        if (n - same) / n <= share:
            valid.append((same, n))
    if not valid:
        return None
    n = valid[0][1] if greedy else max(valid)[1]
    k = len(f) - n
    pick = [(y, b) if b > a else (x, a) for x, a, y, b in zip(f[k:], fq[k:], r, rq, strict=False)]
    return f[:k] + "".join(x for x, _ in pick) + r[n:], fq[:k] + "".join(c for _, c in pick) + rq[n:]


def test_merge_like_plain():
    rng = random.Random(11)
    merged = 0
    for _ in range(400):
        nf, nr = rng.randrange(4, 12), rng.randrange(4, 12)
        whole = word(rng, 24)
        f, r = whole[:nf], whole[rng.randrange(0, nf) :][:nr]
        f, r = ("".join(c if rng.random() > 0.1 else rng.choice("ACGTN") for c in x) for x in (f, r))
        fq, rq = word(rng, len(f), "#5?I"), word(rng, len(r), "#5?I")
        least, most = rng.randrange(1, 4), rng.randrange(4, min(len(f), len(r)) + 1)
        share, greedy = rng.choice([0, 0.2, 0.4]), rng.random() < 0.5
        got = R.merge_pair(f, fq, r, rq, [len(f)], [len(r)], least, most, 0, 0, share, greedy)
        want = plain_merge(f, fq, r, rq, least, min(most, len(f) + len(r) - max(len(f), len(r))), share, greedy)
        assert (got and got[:2]) == want and (got is None or got[2] == [len(got[0])])
        merged += got is not None
    assert 50 < merged < 380


def test_merge_bounds():
    f, r = "GATTACAGG", "ACAGGTTCC"
    run = lambda *a: R.merge_pair(f, q(9, 30), r, q(9, 30), [9], [9], *a, 0, True)
    assert run(1, 9, 0, 0)[0] == "GATTACAGGTTCC" == run(5, 5, 13, 13)[0]
    assert run(10, 9, 0, 0) is run(6, 5, 0, 0) is run(1, 9, 14, 12) is run(1, 4, 0, 0) is None


def test_merge_segments():
    """Breaks between segments: those inside the overlap must be in both mates."""
    rng = random.Random(2)
    for _ in range(200):
        breaks = sorted(rng.sample(range(1, 24), rng.randrange(0, 5)))
        ends = [*breaks, 24]
        whole, k, stop = word(rng, 24), rng.randrange(2, 10), rng.randrange(14, 23)
        cut = lambda lo, hi: [b - a for a, b in zip([lo, *(x for x in ends if lo < x < hi)], [*(x for x in ends if lo < x < hi), hi], strict=True)]  # noqa: E731, B023
        n = stop - k
        args = (whole[:stop], q(stop, 30), whole[k:], q(24 - k, 30))
        got = R.merge_pair(*args, cut(0, stop), cut(k, 24), n, n, 0, 0, 0, True)
        assert got[0] == whole and got[2] == cut(0, 24)
        inside = [x for x in range(k + 1, stop) if x not in breaks]
        if inside:  # a break that only the first mate has
            ends = sorted([*breaks, rng.choice(inside), 24])
            more = cut(0, stop)
            ends = [*breaks, 24]
            assert R.merge_pair(*args, more, cut(k, 24), n, n, 0, 0, 0, True) is None


def plain_groups(positions):
    out = []
    for p in positions:
        if out and p - out[-1][-1] <= 2:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def test_names():
    rng = random.Random(6)
    for _ in range(100):
        ref = word(rng, 30)
        at = sorted(rng.sample(range(1, 31), rng.randrange(1, 6)))
        var = "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i + 1 in at else c for i, c in enumerate(ref))
        ids = [f"{g[0]}{ref[g[0] - 1]}>{var[g[0] - 1]}" if len(g) == 1 else f"{g[0]}_{g[-1]}delins{var[g[0] - 1 : g[-1]]}" for g in plain_groups(at)]
        assert R.base_hgvs(at, ref, var) == (ids[0] if len(ids) == 1 else "[" + ";".join(ids) + "]")
    assert R.aa_hgvs([(2, "W")], "MKLV") == "(Lys2Trp)" and R.aa_hgvs([(1, "*"), (4, "G")], "MKLV") == "[(Met1Ter);(Val4Gly)]"
    assert R.translate("ATNCCA") == "XP" and R.translate("gcuUGA") == "A*" and R.translate("CA_GGG_T") == "_G_"
    assert expand_iupac("RTN") == sorted(a + "T" + c for a in "AG" for c in "ACGT")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ACGT", max_size=7), max_size=30), st.text("ACGTN", max_size=7), st.integers(0, 9))
def test_reference_index(refs, seq, bound):
    """Against a look at all references of the sequence's length that match it anywhere."""
    last = {r: i for i, r in enumerate(refs)}
    near = sorted((sum(map(str.__ne__, seq, r)), i) for r, i in last.items() if len(r) == len(seq))
    near = [(d, i) for d, i in near if d <= bound and d < len(seq)]
    want = -1 if not near else -2 if len(near) > 1 and near[0][0] == near[1][0] else near[0][1]
    assert R.ReferenceIndex(refs, bound).nearest(seq) == want


def test_reference_index_in_the_digest():
    refs = {f"r{i}": r for i, r in enumerate(("ACGACGACG", "TTTACGACG", "ACGACGTTT", "ACGACG"))}
    plain, index = (R.Comparer(refs, 1, -1, [], ".", False, index=x) for x in (False, True))
    for var in ("ACGACGACG", "ACGACGACT", "TTTACGTCG", "GGGGGGGGG", "ACGACGACA", "ACTTTTTTT"):
        assert plain.of(var) == index.of(var)
    assert index.of("ACGAC").failure == "f10a_nbrTooManyMutCodons"


def test_compare():
    ref = "ACGACGACG"
    c = R.Comparer({"f": ref}, 1, -1, ["NNW"], ".", False)
    assert c.of(ref).name == "f.0.WT" and c.of(ref).base_hgvs == "f:c" and c.of(ref).aa_hgvs == "f:p"
    v = c.of("ACGTTGACG")
    assert (v.name, v.base, v.aa, v.n_bases, v.n_codons) == ("f.2.TTG", "f.4.T_f.5.T", "f.2.L", 2, 1) and v.aa_hgvs == "f:p.(Thr2Leu)" and v.types == {"nonsynonymous"}
    assert c.of("ACGACAACG").after_quality == "f11_nbrForbiddenCodons"
    assert c.of("TCGTCGACG").after_quality == "f10a_nbrTooManyMutCodons"
    assert c.of("TTTTTTTTT").failure == "f10a_nbrTooManyMutCodons"
    assert c.of(ref + "A").failure == "f3_nbrReadWrongLength"
    two = R.Comparer({"a": "AAAA", "b": "AATT"}, -1, 2, [], ".", False)
    assert two.of("AAAT").failure == "f8_nbrTooManyBestWTHits" and two.of("AAAA").name == "a.0.WT"
    collapsed = R.Comparer({"x:c": ref}, 1, -1, [], ".", True).of("ACGTTGACG")
    assert (collapsed.name, collapsed.base_hgvs, collapsed.aa_hgvs, collapsed.n_bases) == ("x:c", "x:c", "x:p", 2)
    assert R.Comparer({}, 1, -1, [], ".", False).of("ACG").aa == "T"


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTN", min_size=1, max_size=30))
def test_reverse_complement_twice(s):
    assert R.reverse_complement(R.reverse_complement(s)) == s


def test_cascade_order():
    spec = DigestSpec.of(elementsForward="UCV", elementLengthsForward=[2, 3, 6], wildTypeForward="ACGACG", constantForward="TTT", adapterForward="GGGGGG", mutatedPhredMinForward=30, constantMaxDistForward=1)
    d = R.Digester(spec)
    ok = q(11, 35)
    fail = lambda s, x=ok: d.read(s, x).failure
    assert fail("AATTTACGACG") == "" and fail("GGGGGGACGAC") == "f1_nbrAdapter" and fail("AATTTACGAC", ok[:-1]) == "f3_nbrReadWrongLength"
    assert fail("AATTTACGACG", q(11, 10)) == "f5_nbrAvgVarQualTooLow" and fail("AATTTACGACN") == "f6_nbrTooManyNinVar" and fail("NATTTACGACG") == "f7_nbrTooManyNinUMI"
    assert fail("AATTTACGACC", q(11, 25)) == "f9_nbrMutQualTooLow" and fail("AACCCACGACG") == "f12_nbrTooManyMutConstant"
    with pytest.raises(ValueError):
        d.read("ACGT", "II")


def test_trans_names():
    spec = DigestSpec.of(elementsForward="V", elementLengthsForward=[3], elementsReverse="V", elementLengthsReverse=[3], fastqReverse="r", fastqForward="f", wildTypeForward={"f": "AAA"}, wildTypeReverse={"r": "CCC"}, avePhredMinForward=0, avePhredMinReverse=0)
    r = R.Digester(spec).read("AAG", "III", "CCC", "III")
    assert (r.name, r.sequence, r.lengths, r.base_hgvs, r.n_bases) == ("f.1.AAG_r.0.WT", "AAG_CCC", "3_3", "f:c.3A>G_r:c", 1)


SPECS = [
    dict(elementsForward="UCV", elementLengthsForward=[2, 3, 6], wildTypeForward={"a": "ACGACG", "b": "ACGTTG"}, constantForward=["TTT", "TTA"], adapterForward="GGGGG", mutatedPhredMinForward=25, constantMaxDistForward=1, umiNMax=0),
    dict(elementsForward="UVCV", elementLengthsForward=[1, 3, 3, -1], wildTypeForward="ATTGACG", nbrMutatedCodonsMaxForward=-1, nbrMutatedBasesMaxForward=2, forbiddenMutatedCodonsForward="NNW"),
    dict(elementsForward="CPV", elementLengthsForward=[-1, -1, 6], primerForward=["TTT", "TTA"]),
    dict(elementsForward="UCV", elementLengthsForward=[2, 3, 6], elementsReverse="VU", elementLengthsReverse=[9, 2], wildTypeForward="ACGACG", wildTypeReverse={"r": "AATTTACGA"}, constantForward="TTT", adapterReverse="CCCC", mutatedPhredMinReverse=20),
    dict(elementsForward="SV", elementLengthsForward=[1, -1], elementsReverse="V", elementLengthsReverse=[-1], mergeForwardReverse=True, revComplReverse=True, minOverlap=3, maxFracMismatchOverlap=0.3, wildTypeForward="ATTTACGACGTTTACG", nbrMutatedCodonsMaxForward=3, avePhredMinForward=10),
    dict(elementsForward="V", elementLengthsForward=[-1], elementsReverse="V", elementLengthsReverse=[-1], revComplForward=True, collapseToWTForward=True, wildTypeForward="CGTCGTAAATT", nbrMutatedCodonsMaxForward=4),
]


@pytest.mark.parametrize("args", SPECS, ids=range(len(SPECS)))
def test_batches_like_single_reads(args):
    """The cascade over a batch gives what the cascade gives read by read; every filter of the case takes reads."""
    rng = random.Random(str(args))
    paired = "elementsReverse" in args
    spec = DigestSpec.of(**args, fastqForward="f", **({"fastqReverse": "r"} if paired else {}))
    one, many = R.Digester(spec), BatchDigester(spec)

    def read():
        s = list("AATTTACGACG" if rng.random() < 0.8 else word(rng, rng.randrange(8, 14)))
        for i in range(len(s)):
            if rng.random() < 0.04:
                s[i] = rng.choice("ACGTN")
        s = "".join(s)
        if rng.random() < 0.05:
            s = s[:4] + rng.choice(["GGGGG", "CCCC"])
        return s, "".join(chr(33 + min(40, max(2, int(rng.gauss(rng.choice([15, 30]), 8))))) for _ in s)

    rows = [(*read(), *(read() if paired else ())) for _ in range(1500)]
    if args.get("mergeForwardReverse"):
        rows = [(a, b, R.reverse_complement(a[rng.randrange(2, 6) :] + "TTTACG"), "I" * 30) for a, b, *_ in rows]
    got = many.read(*(pa.array(c, pa.string()) for c in zip(*rows, strict=True)))
    want = [one.read(*r) for r in rows]
    assert got["failure"].to_pylist() == [w.failure for w in want]
    for c in (*TEXT, *COUNTS, *CONST):
        assert got[c].to_pylist() == [getattr(w, c) for w in want], c
    assert [x or [] for x in got["types"].to_pylist()] == [list(w.types) for w in want]
    assert len({w.failure for w in want}) >= 3 and sum(not w.failure for w in want) > 20
    empty = many.read(*(pa.array([], pa.string()) for _ in rows[0]))
    assert all(len(x) == 0 for x in empty.values())
