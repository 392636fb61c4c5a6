import numpy as np
import pytest

from skein import types as D
from skein.errors import ArgumentInvalid, DTypeInferenceFailed, RaggedError

NUMERIC = [t for t in D.ALL if t.kind in "biuf"]


@pytest.mark.parametrize("a", NUMERIC, ids=str)
@pytest.mark.parametrize("b", NUMERIC, ids=str)
def test_casts_follow_numpy(a, b):
    for mode in ("safe", "same_kind", "unsafe"):
        assert D.can_cast(a, b, mode) == np.can_cast(a.name, b.name, mode), mode
    assert D.promote_types(a, b).name == np.promote_types(a.name, b.name).name


def test_text():
    assert D.can_cast("char", "string") and not D.can_cast("string", "char")
    assert D.can_cast("string", "char", "same_kind") and not D.can_cast("string", "int32", "unsafe")
    with pytest.raises(ArgumentInvalid):
        D.can_cast("int8", "int16", "never")


def test_inference():
    assert D.infer([None, True]) == D.bool_ and D.infer([True, 2]) == D.int64 and D.infer([1, 2.0]) == D.float64
    assert D.infer(["a"]) == D.char and D.infer(["ab"]) == D.string
    for bad in ([None], ["a", "ab"], ["a", 1], [object()]):
        with pytest.raises(DTypeInferenceFailed):
            D.infer(bad)


def test_error_shape():
    text = str(DTypeInferenceFailed("no dtype", "all null", "pass dtype=", rows=3))
    assert text.splitlines() == ["DTypeInferenceFailed: no dtype", "  cause: all null", "  rows: 3", "  fix: pass dtype="]
    assert issubclass(DTypeInferenceFailed, RaggedError) and issubclass(DTypeInferenceFailed, TypeError)
