from .dataset import CellDataset, from_embeddings, from_events, from_frames, from_lineitem, from_matrix, from_wide, load, read_gene_list, read_gene_sets, resolve_path, verify_sha256

__all__ = ["CellDataset", "from_embeddings", "from_events", "from_frames", "from_lineitem", "from_matrix", "from_wide", "load", "read_gene_list", "read_gene_sets", "resolve_path", "verify_sha256"]
