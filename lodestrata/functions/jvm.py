"""Functions that run inside the executors' JVMs, for what is too slow in Python.

Their Java source lies in this folder. It is compiled on the driver by the compiler that Spark
itself uses for its generated code, and goes to the executors as a jar.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SOURCE = Path(__file__).with_name("SeqRatio.java")


def _compile(context: SparkContext) -> None:
    compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(SOURCE.read_text(encoding="utf-8"))
    folder = Path(tempfile.mkdtemp(prefix="lodestrata-"))  # the driver's own: executors fetch the jar from Spark
    atexit.register(shutil.rmtree, folder, True)
    path = folder / "lodestrata_functions.jar"
    with zipfile.ZipFile(path, "w") as z:
        for name, code in dict(compiler.getBytecodes()).items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    context._lodestrata_jar, context._lodestrata_loader = str(path), compiler.getClassLoader()


def register(spark: SparkSession) -> None:
    """Make ``lodestrata_seq_ratio`` known to the session and its class to the executors."""
    context = spark.sparkContext
    if not getattr(context, "_lodestrata_jar", None):
        _compile(context)
    if getattr(spark, "_lodestrata_registered", False):
        return
    spark._jsparkSession.sessionState().resourceLoader().addJar(context._lodestrata_jar)
    function = context._lodestrata_loader.loadClass("lodestrata.SeqRatio").getDeclaredConstructors()[0].newInstance(None)
    spark._jsparkSession.udf().register("lodestrata_seq_ratio", function, spark._jvm.org.apache.spark.sql.types.DataTypes.DoubleType)
    spark._lodestrata_registered = True


def seq_ratio(spark: SparkSession, a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp similarity of two texts (null: empty), as ``udfs.seq_ratio`` gives it."""
    register(spark)
    return F.call_function("lodestrata_seq_ratio", F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
