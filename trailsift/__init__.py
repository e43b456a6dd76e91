"""trailsift: reconnaissance detection over cloud audit logs, built on Spark DataFrames.

Subpackages
-----------
sources    readers (JSON envelopes, the test-table adapter) and writers
functions  scalar column expressions (hashes, IP/user-agent encodings, JSON sizes)
operators  filters, feature encoding, distributed DBSCAN, cluster profiles, timeframes
plans      the end-to-end detection job and the registered queries
streaming  incremental rolling density with Structured Streaming
"""

from trailsift.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
