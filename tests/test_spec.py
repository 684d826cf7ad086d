import pytest

from mavelake.checks import assert_packages_available, assert_scalar, assert_vector
from mavelake.spec import DigestSpec


@pytest.mark.parametrize(
    "bad",
    [
        dict(elementsForward="AX", elementLengthsForward=[1, 2]),
        dict(elementsForward="UV", elementLengthsForward=[1]),
        dict(elementsForward="VV", elementLengthsForward=[-1, -1]),
        dict(elementsForward="VPVP", elementLengthsForward=[1, 1, 1, 1]),
        dict(wildTypeForward="ACGX"),
        dict(wildTypeForward={"a": "ACG", "b": "acg"}),
        dict(wildTypeForward="ACG", nbrMutatedCodonsMaxForward=1, nbrMutatedBasesMaxForward=1),
        dict(adapterForward="AC-"),
        dict(mutNameDelimiter="_"),
        dict(mutNameDelimiter=".."),
        dict(wildTypeForward={"a.b": "ACG"}),
        dict(constantForward=["ACG", "AC"]),
        dict(constantForward="ACG", elementsForward="C", elementLengthsForward=[2]),
        dict(forbiddenMutatedCodonsForward="NN"),
        dict(maxNReads=0),
        dict(avePhredMinForward=-1),
        dict(maxFracMismatchOverlap=2),
        dict(nThreads=0),
        dict(filteredReadsFastqForward="x.fastq"),
        dict(mergeForwardReverse="yes"),
    ],
)
def test_bad_arguments(bad):
    with pytest.raises((ValueError, TypeError)):
        DigestSpec.of(**bad)


def test_normalises():
    s = DigestSpec.of(wildTypeForward="acg", primerForward=["ac"], elementsForward="P", elementLengthsForward=[-1])
    assert s.wildTypeForward == {"f": "ACG"} and s.primerForward == ["AC"]
    with pytest.warns(DeprecationWarning):
        DigestSpec.of(variableCollapseMaxDist=1)
    with pytest.raises(TypeError):
        DigestSpec.of(noSuchArgument=1)
    with pytest.raises(FileNotFoundError):
        DigestSpec.of(True, fastqForward="/nowhere.fastq")


def test_checks():
    assert_scalar(5, "x", "numeric", rng_incl=(0, 5))
    assert_scalar(-1, "x", "numeric", rng_incl=(0, 5), valid_values=[-1])
    assert_scalar(None, "x", allow_null=True)
    for bad in (dict(x=6, rng_incl=(0, 5)), dict(x=5, rng_excl=(0, 5)), dict(x=[1, 2]), dict(x=None)):
        with pytest.raises(ValueError):
            assert_scalar(bad.pop("x"), "x", "numeric", **bad)
    with pytest.raises(TypeError):
        assert_vector([1, "a"], "x", "numeric")
    with pytest.raises(ValueError):
        assert_vector([1, 2], "x", "numeric", length=3)
    with pytest.raises(ImportError):
        assert_packages_available(["no_such_package_here"])
