import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def labelled(spark, tmp_path_factory):
    """A labelled batch of messy files, read, run and scored: (folder, batch, run)."""
    from ledgerloom.plans import cascade
    from ledgerloom.sources import files, generator

    folder = str(tmp_path_factory.mktemp("batch"))
    made = generator.generate(spark, 250, seed=3)
    files.write_csv(made.files, folder)
    made.truth.write.json(f"{folder}/truth")
    batch = files.load_batch(spark, folder)
    truth = spark.read.schema(files.TRUTH).json(f"{folder}/truth")
    return folder, batch, cascade.run(batch, truth=truth)
