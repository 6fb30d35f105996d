import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(*sorted(e.queries()))"


def names(folder):
    run = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr[-2000:]
    return set(run.stdout.split())


def copied(folder, *without):
    shutil.copytree(ROOT, folder, ignore=lambda d, found: [n for n in found if n in {".git", "__pycache__", ".pytest_cache"}
                                                           or str(pathlib.Path(d, n).relative_to(ROOT)) in without])
    return folder


@pytest.mark.parametrize("without", [("arborlake/llm", "tests/llm"), ("arborlake/llm", "tests/llm", "corpus_pipeline.py")])
def test_rest_works_without_the_optional_subpackage(tmp_path, without):
    left = names(copied(tmp_path / "tree", *without))
    assert "object_pixel_iou" in left and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in left)


def test_a_fault_inside_the_subpackage_is_not_swallowed(tmp_path):
    tree = copied(tmp_path / "tree")
    if not (tree / "arborlake/llm").exists():
        pytest.skip("nothing to break")
    (tree / "arborlake/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    run = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=tree, capture_output=True, text=True, check=False)
    assert run.returncode and "a_module_that_is_not_there" in run.stderr
