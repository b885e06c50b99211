"""kbpipe: a PySpark-native knowledge-base pipeline.

Pages and document text become redacted, chunked, embedded tables; batches of
questions become retrieval hits and prompts; request and spend events become
alerts. Every operator is a lazy ``DataFrame -> DataFrame`` or
``Column -> Column`` function so Catalyst plans the whole job.
"""

__version__ = "0.1.0"
