"""Analytics over recorded site audits, expressed as Spark DataFrame plans.

Layout: ``functions`` (column expressions), ``sources`` and ``sinks`` (readers and
writers), ``operators`` (reusable DataFrame -> DataFrame operators), ``plans``
(read models and rules built from them), ``streaming`` (incremental versions).
"""
