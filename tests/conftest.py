import gzip
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "1")
        .config("spark.sql.adaptive.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def audit(spark, tmp_path):
    """audit(fasta texts, gfa lines, ...): writes files and runs the audit. Blanks between GFA fields stand for tabs, `;` for line ends."""
    from braidcheck.api import audit_gfa

    def run(fasta, gfa, zipped=False, raw=False, **options):
        texts = [fasta] if isinstance(fasta, str) else fasta
        put = (lambda p, b: p.write_bytes(gzip.compress(b))) if zipped else (lambda p, b: p.write_bytes(b))
        paths = []
        for i, text in enumerate(texts):
            path = tmp_path / f"source {i} Ω.fa"
            put(path, text.encode() if isinstance(text, str) else text)
            paths.append(str(path))
        graph = tmp_path / "graph [α].gfa"
        text = gfa if raw else "\n".join("\t".join("" if f == "_" else f for f in line.split()) for line in gfa.split(";")) + "\n"
        put(graph, text.encode())
        return audit_gfa(spark, paths if len(paths) > 1 else paths[0], str(graph), **options)

    return run
