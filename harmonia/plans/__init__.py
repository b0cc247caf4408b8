"""Key algebra: which spectra, blocks and products a run needs."""
