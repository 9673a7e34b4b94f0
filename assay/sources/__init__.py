"""Tables on disk: JSON lines, packs, digests, committed bundles, stage logs."""
