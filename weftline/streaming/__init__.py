"""The incremental state machines as Structured Streaming queries.

Every query reads with ``availableNow`` or continuously, keeps its state in
checkpoints in the shared folder, and gives the same result as its batch twin.
"""
