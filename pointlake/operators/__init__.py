"""Table-to-table operators over points, sequences, graphs and rasters."""
