"""A PySpark engine for cleaning, denoising and clustering amplicon sequencing reads."""
