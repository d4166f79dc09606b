"""tidings: Spark-native analytics over dated news corpora.

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from the DataFrame / SQL API so that Catalyst plans it.
"""

__version__ = "0.1.0"
