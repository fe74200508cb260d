"""The reads table and the typed results of the operators."""

from pyspark.sql.types import StringType, StructField, StructType

READS = StructType([StructField("id", StringType(), False), StructField("sequence", StringType(), False), StructField("quality", StringType(), True)])

#: Fixed default parameters.
MIN_QUALITY = 20
MASK_BELOW = 53
MIN_LENGTH = 50
ADAPTER = "AGATCGGAAGAGC"
ADAPTER_OVERLAP = 5
KMER = 21
SKETCH_K, SKETCH_SIZE = 21, 1000
EDIT_MAX = 1000
