"""The operators: dataset conversion, demographics, time and route inference, covariate sampling."""

from .demographics import create_demographics_table
from .layouts import UnsupportedConversion, detect_dataset_type, reformat_data
from .modeling import Dictionary, modeling_to_modeling, modeling_to_nca
from .nca import nca_to_modeling
from .nominal import add_nominal_timepoints, get_nominal_timepoints, match_closest
from .route import get_route_from_data_column
from .sampling import impute_missing, sample_covariates, sample_covariates_bootstrap, sample_covariates_mice, sample_covariates_mvtnorm
from .sdtm import sdtm_to_adppk, sdtm_to_modeling
from .study_data import get_data_for_modelfit, get_data_for_nca

__all__ = [
    "Dictionary", "UnsupportedConversion", "add_nominal_timepoints", "create_demographics_table", "detect_dataset_type", "get_data_for_modelfit", "get_data_for_nca", "get_nominal_timepoints", "get_route_from_data_column", "impute_missing", "match_closest",
    "modeling_to_modeling", "modeling_to_nca", "nca_to_modeling", "reformat_data", "sample_covariates", "sample_covariates_bootstrap", "sample_covariates_mice", "sample_covariates_mvtnorm", "sdtm_to_adppk", "sdtm_to_modeling",
]
