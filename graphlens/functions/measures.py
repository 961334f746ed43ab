"""The registry of measures: key, function, direction, display name."""

from __future__ import annotations

from . import kernels as k

MEASURES = {
    "frobenius": k.frobenius,
    "hamming": k.hamming,
    "jaccard": k.jaccard,
    "f1": k.f1,
    "network_mutual_information": k.mutual_information,
    "dc_network_mutual_information": k.degree_corrected_information,
    "spectral_distance_adjacency": k.spectral_adjacency,
    "spectral_distance_norm_laplacian": k.spectral_laplacian,
    "netrd_non_backtracking_spectral": k.non_backtracking,
    "portrait": k.portrait_divergence,
    "net_simile": k.net_simile,
    "delta_con": k.delta_con,
    "communicability_corr": k.communicability_correlation,
    "communicability_jsd": k.communicability_divergence,
    "resistance": k.resistance,
    "energy": k.energy,
}
#: The KS statistics inside the energy, which landscapes carry too.
COMPONENTS = dict(k.KS)
SIMILARITIES = frozenset({"jaccard", "f1", "network_mutual_information", "dc_network_mutual_information", "communicability_corr"})
SELECTED = ("frobenius", "delta_con", "netrd_non_backtracking_spectral", "spectral_distance_adjacency", "communicability_corr", "portrait", "net_simile", "energy")
NAMES = {
    "frobenius": "Frobenius",
    "hamming": "Hamming",
    "jaccard": "Jaccard",
    "f1": "F1",
    "network_mutual_information": "NMI",
    "dc_network_mutual_information": "DC-NMI",
    "spectral_distance_adjacency": "Spectral (adjacency)",
    "spectral_distance_norm_laplacian": "Spectral (normalized Laplacian)",
    "netrd_non_backtracking_spectral": "Spectral (non-backtracking)",
    "portrait": "Portrait divergence",
    "net_simile": "NetSimile",
    "delta_con": "DeltaCon",
    "communicability_corr": "Communicability correlation",
    "communicability_jsd": "Communicability JSD",
    "resistance": "Resistance distance",
    "energy": "KS-based energy",
}
