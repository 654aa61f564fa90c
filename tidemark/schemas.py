"""Row contracts of the raw tables and logs."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the raw tables.
_L, _S, _D, _TS, _I = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampNTZType(), T.IntegerType()


def _schema(spec: str) -> T.StructType:
    kinds = {"long": _L, "string": _S, "double": _D, "timestamp": _TS, "int": _I}
    fields = []
    for line in spec.split(","):
        name, kind = line.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


EXAM_REPORTS = _schema(
    "NM_EXAME string?, CD_ATENDIMENTO long, DT_ATENDIMENTO timestamp, DS_LAUDO_MEDICO string?, CD_PACIENTE long"
)
CONFIRMATIONS = _schema(
    "CD_PACIENTE long?, CD_ATENDIMENTO long, DT_ATENDIMENTO timestamp, CD_PROCEDIMENTO string, "
    "DT_PROCEDIMENTO_REALIZADO timestamp?, NM_EXAME string?, DS_LAUDO_MEDICO string?, "
    "CD_OCORRENCIA long?, CD_ORDEM long?, CD_MODELO_LAUDO string?"
)
QUESTIONNAIRES = _schema(
    "CD_ATENDIMENTO long, CD_PACIENTE long, CD_PESSOA long, CD_USUARIO string?, "
    "DS_INDICACAO_QUEIXA string?, DT_ATENDIMENTO timestamp, DS_MENARCA string?, DS_MENOPAUSA string?, "
    "NU_GESTACAO double?, NU_GESTACAO_ABORTO double?, FL_ALEITAMENTO string?, "
    "FL_CA_MAMA_MAE string?, FL_CA_MAMA_IRMA string?, FL_CA_MAMA_AVO string?, FL_CA_MAMA_TIA string?, "
    "DT_BIOPSIA_ME timestamp?, DT_BIOPSIA_MD timestamp?, "
    "DT_QUADRANTECTOMIA_ME timestamp?, DT_QUADRANTECTOMIA_MD timestamp?, "
    "DT_MASTECTOMIA_ME timestamp?, DT_MASTECTOMIA_MD timestamp?, "
    "DT_PLASTICA_ME timestamp?, DT_PLASTICA_MD timestamp?, "
    "FL_BIOPSIA_ME string?, FL_BIOPSIA_MD string?, "
    "FL_QUADRANTECTOMIA_ME string?, FL_QUADRANTECTOMIA_MD string?, "
    "FL_MASTECTOMIA_ME string?, FL_MASTECTOMIA_MD string?, FL_PLASTICA_ME string?, FL_PLASTICA_MD string?"
)
PERSONS = _schema(
    "CD_PESSOA long, CD_PACIENTE long?, CD_USUARIO string?, DT_NASCIMENTO_FUNDACAO timestamp?, "
    "NM_PESSOA_RAZAO_SOCIAL string?, NM_MAE string?, FL_SEXO string?, DS_ALTURA string?, DS_PESO string?, "
    "NM_CIDADE_ENDERECO string?, CD_CEP_ENDERECO string?"
)
PATIENTS = _schema(
    "CD_PACIENTE long, CD_USUARIO string?, CD_PESSOA long?, DT_NASCIMENTO timestamp?, CD_SEXO string?, "
    "NM_PACIENTE string?, NM_MUNICIPIO string?, CD_UF string?, NM_MAE string?, NM_PAI string?, "
    "CD_TIPO_ENDERECO string?, NM_BAIRRO string?, NU_CEP string?"
)
USERS = _schema(
    "CD_USUARIO string, CD_PACIENTE long?, CD_PESSOA long?, NU_USUARIO long, NU_TITULAR long, "
    "CD_CANCELAMENTO long?, DT_REFERENCIA_CARENCIA timestamp?, DT_CADASTRAMENTO timestamp?, "
    "DT_CANCELAMENTO timestamp?, DT_MENSALIDADE_A timestamp?, VL_MENSALIDADE_A double?, "
    "VL_MENSALIDADE double?, VL_TAXA_ADESAO double?"
)

TUNING_PARAMS = T.StructType(
    [
        T.StructField("dropout", _D), T.StructField("depth", _I), T.StructField("layer_0_units", _I),
        T.StructField("weight_decay", _D), T.StructField("learning_rate", _D), T.StructField("optimizer", _S),
    ]
)
TUNING_LOG = T.StructType(
    [
        T.StructField("trial_number", _I), T.StructField("init_date", _S), T.StructField("load_id", _S),
        T.StructField("dataset_name", _S), T.StructField("split_config_name", _S), T.StructField("target_year", _I),
        T.StructField("total_epochs_per_trial", _I), T.StructField("result", _D),
        T.StructField("params", TUNING_PARAMS),
    ]
)
METRICS = T.StructType(
    [T.StructField("CV", _I), T.StructField("Loss", _D), T.StructField("AUROC", _D), T.StructField("Average Precision", _D)]
)
TRAINING_LOG = T.StructType(
    [
        T.StructField("config_dir_path", _S), T.StructField("split_config_name", _S),
        T.StructField("training_config_name", _S), T.StructField("epoch", _I),
        T.StructField("target year", _I), T.StructField("training metrics", METRICS),
        T.StructField("validation metrics", METRICS),
    ]
)
