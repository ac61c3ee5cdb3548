"""Small vectorised kernels that run inside grouped Python workers; numpy only."""
