from __future__ import annotations

import numpy as np
import pytest

from rasterloom.__main__ import main
from rasterloom.sources import tiff


def samples(path: str) -> np.ndarray:
    layout = tiff.read_layout(path)
    with tiff._open(path) as f:
        return tiff.read_region(f, layout, 0, 0, layout.width, layout.height)


def test_generate_and_run(spark, tmp_path, capsys):
    image, out = str(tmp_path / "in.tiff"), str(tmp_path / "out.tiff")
    assert main(["generate", "150", "90", "--tile", "64", "--block", "32", "--out", image]) == 0
    assert main(["run", image, out, "--tile-size", "40"]) == 0
    assert (samples(out) == samples(image)).all()
    assert main(["run", image, out, "--tile-size", "40", "--mode", "both", "--transform", "blur", "3", "--transform", "crop", "10", "5", "100", "80"]) == 0
    assert (samples(out) == samples(out + ".seq.tiff")).all()
    assert (samples(out)[75:] == 0).all()
    assert "speedup" in capsys.readouterr().out
    assert main(["run", image, out, "--mode", "hetero", "--gpu", "--cpu-tile-size", "64", "--transform", "blur", "4"]) == 0
    assert "Compute-heavy transform" in capsys.readouterr().out


@pytest.mark.parametrize("argv", [["run", "a.tiff"], ["run", "a", "b", "--mode", "warp"], ["run", "a", "b", "--transform", "blur", "x"], ["run", "a", "b", "--transform", "melt"], ["run", "a", "b", "--transform", "identity", "--transform", "blur", "2"]])
def test_bad_arguments(argv, capsys):
    assert main(argv) == 1


def test_failures(spark, tmp_path):
    assert main(["run", str(tmp_path / "none.tiff"), str(tmp_path / "o.tiff")]) == 2
