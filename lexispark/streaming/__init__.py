"""No operator of this library has streaming semantics; checks run on bounded tables, or in foreachBatch on each micro-batch as an ordinary DataFrame."""
