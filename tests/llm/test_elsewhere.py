"""The operators where executors find no copy of the package: started from another folder, the driver alone knows where it lies."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import os, sys
sys.path.insert(0, sys.argv[1])
from foldmark.session import get_spark
from foldmark.llm.queries import QUERIES
spark = get_spark(4, "elsewhere")
docs = spark.createDataFrame([(i, f"the cat number {i % 7} sat on the mat and the dog {i % 5} did not " * 3, "en", f"s{i % 2}", 9) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
docs.write.parquet(sys.argv[2] + "/documents.parquet")
spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.5]) for i in range(30)], "vec_id long, embedding array<double>").write.parquet(sys.argv[2] + "/embeddings.parquet")
spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(sys.argv[2] + "/labels.parquet")
spark.createDataFrame([(1, "the cat number 3 sat on the mat and the dog"), (2, "x")], "item_id long, text string").write.parquet(sys.argv[2] + "/benchmark.parquet")
spark.createDataFrame([(i, f"http://a.com/{i}", f"<nav>menu</nav><article><p>Some text, here. {i}</p></article>") for i in range(20)], "page_id long, url string, html string").write.parquet(sys.argv[2] + "/pages.parquet")
for number in ("2", "3", "4", "6", "9", "10", "11", "13"):
    (name,) = [n for n in QUERIES if n.startswith(f"op{number}_")]
    print("rows", name, QUERIES[name](spark, sys.argv[2]).count() > 0)
"""


def test_started_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    (tmp_path / "data").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), HERE, str(tmp_path / "data")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    rows = [line.split()[1:] for line in done.stdout.splitlines() if line.startswith("rows ")]
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(rows) == 8 and all(found == "True" for _, found in rows)
