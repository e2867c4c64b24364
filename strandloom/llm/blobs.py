"""The name that op2, op4 and op8 had for it; see ``strandloom.blobs``."""

from strandloom.blobs import SCHEMES, Reader, Writer, fs, store_of

__all__ = ["SCHEMES", "Reader", "Writer", "fs", "store_of"]
