"""The range coder as column functions that run in the executors' JVM.

range_coder.py fixes the format; its loop over ids costs NumPy some microseconds an id.
RangeCoder.java does the same arithmetic and gives the same bytes. Spark's own compiler
(Janino, which compiles its generated code) makes classes of it in the driver; a jar
takes them to the executors, so that no machine needs a compiler.
"""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_CLASS = "meterlens.RangeCoder"


def _load(spark: SparkSession) -> None:
    """Makes the functions known to this session; their jar goes to the application's executors."""
    jvm, own = spark.sparkContext._jvm, spark._jsparkSession
    if own.catalog().functionExists("meterlens_decode_ids"):
        return
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(pkgutil.get_data(__package__, "RangeCoder.java").decode())
    handle, path = tempfile.mkstemp(suffix=".jar", prefix="meterlens-")
    with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w") as jar:
        for name, code in dict(compiler.getBytecodes()).items():
            jar.writestr(name.replace(".", "/") + ".class", bytes(code))
    jvm.java.io.File(path).deleteOnExit()
    spark.sql(f"ADD JAR '{path}'").collect()
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    binary = jvm.org.apache.spark.sql.types.DataType.fromDDL("binary")
    for name, part in (("encode", "Encode"), ("decode", "Decode")):
        function = loader.loadClass(f"{_CLASS}${part}").getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
        own.udf().register(f"meterlens_{name}_ids", function, binary)


def encoded(spark: SparkSession, ids: Column) -> Column:
    """Blocks, as they stand in a file, of a binary column of ids as little-endian 32-bit integers."""
    _load(spark)
    return F.call_function("meterlens_encode_ids", ids)


def decoded(spark: SparkSession, blocks: Column) -> Column:
    """The ids of encoded() blocks; fails where a checksum differs."""
    _load(spark)
    return F.call_function("meterlens_decode_ids", blocks)
