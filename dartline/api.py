"""The public names in one place."""

from dartline.operators.connectivity import characteristic_path_length, components, distance_matrix, distances, largest_connected_component, spanning_tree
from dartline.operators.curvature import (
    edge_curvatures,
    lin_lu_yau_curvature,
    node_curvature,
    ollivier_ricci_curvature,
    resistance_curvature,
    resistance_curvature_from_distance,
    resistance_distance,
    steinerberger_curvature,
    steinerberger_curvature_from_distance,
)
from dartline.operators.graph import canonical, darts, induced_subgraph, undirected_simple, upper_triangle
from dartline.operators.linkpred import EarlyStopping, edge_overlap, link_prediction, link_prediction_from_walks, link_split, train_subsample
from dartline.operators.rotation import (
    all_darts,
    check_faces,
    dart_face_to_vertex_sequence,
    face_vertex_sequences,
    faces_from_pi,
    faces_from_rotation,
    facial_successor,
    facial_walks,
    facial_walks_from_curvature_signs,
    pi_from_rotation,
    random_rotation,
    rotation_from_curvature_signs,
    rotation_from_pi,
)
from dartline.operators.scores import aggregate_scores, reconstruct_graph, sample_graph, symmetrize_scores, transition_counts
from dartline.operators.stats import (
    average_rank,
    clustering_coefficient,
    community_density,
    compute_graph_statistics,
    degree_assortativity,
    max_degree,
    power_law_exponent,
    triangle_count,
)
from dartline.operators.tokens import batches, collate, face_chunks
from dartline.operators.walks import random_walk_corpus
from dartline.plans.experiment import Config, train_model
from dartline.plans.model import CountModel, generate, generate_walks, model_transition_counts
from dartline.sources.tables import load_graph_dataset, read_graph

__all__ = [n for n in dir() if not n.startswith("_")]
