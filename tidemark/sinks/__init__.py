"""Writers and content digests."""
