"""corpusmap: text -> table -> vector -> map jobs expressed as Spark DataFrame plans.

Sub-packages:
  functions/  native Column expressions (text, vectors)
  sources/    parsers for responses, listings, pages, headers; store I/O; stand-in tables
  operators/  upserts, selections, projections, similarity, encoders, aggregates
  plans/      composed jobs (dataset maps, query answering) and the query registry
  streaming/  Structured Streaming wrappers (file source + foreachBatch)
"""

__version__ = "0.1.0"
