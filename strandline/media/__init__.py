"""Encoded media without codecs: boxes, packets, digests, and copying packets between files."""
