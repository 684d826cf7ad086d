"""Tables and Column functions for sequences, all of them JVM expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "TCAG"
#: Amino acids of the standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT ... GGG (fixed values).
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE = {"".join(c): a for c, a in zip(itertools.product(BASES, repeat=3), AMINO, strict=True)}
#: Three-letter names of the amino acids (fixed values).
THREE = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "E": "Glu", "Q": "Gln", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter"}


def reverse_complement(seq: Column) -> Column:
    """The other strand; anything but ACGTN is an error."""
    checked = F.when(seq.rlike("^[ACGTNacgtn]*$"), seq).otherwise(F.raise_error(F.concat(F.lit("only ACGTN can be complemented: "), seq)))
    return F.reverse(F.translate(F.when(seq.isNotNull(), checked), "ACGTNacgtn", "TGCANTGCAN"))


def translate(seq: Column) -> Column:
    """Protein; parts between underscores each start a new frame, unknown codons are X, a partial codon is dropped."""
    table = F.create_map(*(F.lit(x) for kv in CODE.items() for x in kv))
    upper = F.translate(F.upper(seq), "U", "T")

    def part(p: Column) -> Column:
        codons = F.filter(F.split(F.regexp_replace(p, "(?s)(...)", "$1\u0001"), "\u0001"), lambda c: F.length(c) == 3)
        return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")

    return F.array_join(F.transform(F.split(upper, "_", -1), part), "_")


def three_letter(aa: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in THREE.items() for x in kv)), aa), F.lit(""))


def count_n(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def qualities(qual: Column, offset: int = 33) -> Column:
    """Phred qualities as integers."""
    return F.when(qual == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(qual, ""), lambda c: F.ascii(c) - offset))


def mean_quality(qual: Column, offset: int = 33) -> Column:
    return F.try_divide(F.aggregate(qualities(qual, offset), F.lit(0), lambda a, x: a + x), F.length(qual))


def _letters(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of one length; null for different lengths."""
    d = F.aggregate(F.zip_with(_letters(a), _letters(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), d)


def hamming_shift(a: Column, b: Column, max_abs_shift: int = -1) -> Column:
    """The least of 2 |s| plus the differing places of the overlap when b is shifted by s places against a."""
    n = F.length(a)
    most = n - 1 if max_abs_shift == -1 else F.least(F.lit(max_abs_shift), n - 1)

    def at(s: Column) -> Column:
        rest = n - F.abs(s)
        return 2 * F.abs(s) + hamming(F.substring(a, F.greatest(s, F.lit(0)) + 1, rest), F.substring(b, F.greatest(-s, F.lit(0)) + 1, rest))

    best = F.array_min(F.transform(F.sequence(-most, most), at))
    return F.when(F.length(a) == F.length(b), F.when(n == 0, F.lit(0)).otherwise(F.least(n, best)))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def mismatches(var: Column, ref: Column) -> Column:
    """Structs (i, v, r) of the places (0-based) at which var and ref differ, over the shorter of both."""
    n = F.least(F.length(var), F.length(ref))
    all_ = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.substring(var, i + 1, F.lit(1)).alias("v"), F.substring(ref, i + 1, F.lit(1)).alias("r"))))
    return F.coalesce(F.filter(all_, lambda x: x.v != x.r), F.array().cast("array<struct<i:int,v:string,r:string>>"))


def mutated_codons(var: Column, ref: Column) -> Column:
    """Structs (p, v, r): 1-based codon number, new and old codon, in order."""
    numbers = F.array_distinct(F.transform(mismatches(var, ref), lambda x: F.floor(x.i / 3).cast("int")))
    return F.transform(numbers, lambda c: F.struct((c + 1).alias("p"), F.substring(var, 3 * c + 1, F.lit(3)).alias("v"), F.substring(ref, 3 * c + 1, F.lit(3)).alias("r")))


def variant_name(changes: Column, ref_name: str, value: str = "v", delimiter: str = ".") -> Column:
    """`ref.pos.value` joined by underscores, or `ref.0.WT` where nothing changed."""
    head = F.lit(ref_name + delimiter)
    return F.when(F.size(changes) == 0, F.lit(f"{ref_name}{delimiter}0{delimiter}WT")).otherwise(F.array_join(F.transform(changes, lambda x: F.concat(head, x.p.cast("string"), F.lit(delimiter), x[value])), "_"))


def base_hgvs(diff: Column, var: Column, ref_name: str) -> Column:
    """HGVS name of base changes (structs of `mismatches`): those at most two apart are one deletion-insertion."""
    empty = F.array().cast("array<struct<a:int,b:int,r:string>>")

    def add(groups: Column, x: Column) -> Column:
        p = x.i + 1
        last = F.try_element_at(groups, F.lit(-1))
        new = F.struct(p.alias("a"), p.alias("b"), x.r.alias("r"))
        grown = F.struct(last.a.alias("a"), p.alias("b"), last.r.alias("r"))
        joins = (F.size(groups) > 0) & (p - last.b <= 2)
        return F.when(joins, F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(groups, F.array(new)))

    groups = F.aggregate(diff, empty, add)
    ids = F.transform(groups, lambda g: F.when(g.a == g.b, F.concat(g.a.cast("string"), g.r, F.lit(">"), F.substring(var, g.a, F.lit(1)))).otherwise(F.concat(g.a.cast("string"), F.lit("_"), g.b.cast("string"), F.lit("delins"), F.substring(var, g.a, g.b - g.a + 1))))
    name = F.lit(ref_name if ref_name.endswith(":c") else ref_name + ":c")
    return F.when(F.size(diff) == 0, name).when(F.size(groups) == 1, F.concat(name, F.lit("."), ids[0])).otherwise(F.concat(name, F.lit(".["), F.array_join(ids, ";"), F.lit("]")))


def aa_changes(codons: Column) -> Column:
    """Structs (p, v, r) of changed amino acids, from structs of `mutated_codons`."""
    all_ = F.transform(codons, lambda x: F.struct(x.p.alias("p"), translate(x.v).alias("v"), translate(x.r).alias("r")))
    return F.filter(all_, lambda x: x.v != x.r)


def aa_hgvs(changes: Column, ref_name: str) -> Column:
    name = F.lit((ref_name[:-2] if ref_name.endswith(":c") else ref_name) + ":p")
    ids = F.transform(changes, lambda x: F.concat(F.lit("("), three_letter(x.r), x.p.cast("string"), three_letter(x.v), F.lit(")")))
    return F.when(F.size(changes) == 0, name).when(F.size(changes) == 1, F.concat(name, F.lit("."), ids[0])).otherwise(F.concat(name, F.lit(".["), F.array_join(ids, ";"), F.lit("]")))


def mutation_types(codons: Column) -> Column:
    kinds = F.transform(codons, lambda x: F.when(translate(x.v) == translate(x.r), "silent").when(translate(x.v) == "*", "stop").otherwise("nonsynonymous"))
    return F.array_join(F.array_sort(F.array_distinct(kinds)), ",")
