"""Fixed schemas of the registry tables and exchange files; never inferred."""

from pyspark.sql import types as T

_S, _I, _D, _B, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


DOCUMENTS = _struct(
    document_id=_S, filename=_S, status=_S, script_type=_S, is_synthetic=_B, dpdp_status=_S, dpdp_reason=_S,
    uploaded_at=_TS, uploaded_by=_S, overall_confidence=_D, extraction_notes=_S, storage_path=_S, mime_type=_S,
    file_size_bytes=_I, reupload_count=_I,
)
EXTRACTED_FIELDS = _struct(
    id=_S, document_id=_S, field_name=_S, field_value=_S, field_value_en=_S, confidence=_D, source=_S,
)
VALIDATION_RESULTS = _struct(id=_S, document_id=_S, rule_name=_S, result=_S, message=_S)
REVIEWS = _struct(
    id=_S, document_id=_S, reviewer_id=_S, action=_S, notes=_S, reviewed_at=_TS, duration_seconds=_I,
    corrections=T.MapType(_S, _S),
)
FIELD_CORRECTIONS = _struct(
    id=_S, extracted_field_id=_S, review_id=_S, previous_value=_S, corrected_value=_S, created_at=_TS,
)
EMBEDDINGS = _struct(document_id=_S, searchable_text=_S, embedding=T.ArrayType(T.FloatType()), created_at=_TS)
RULE_CONFIGS = _struct(key=_S, name=_S, description=_S, severity=_S, enabled=_B)
ERROR_RATES = _struct(id=_S, script_type=_S, engine=_S, cer=_D, sample_size=_I)
ENGINE_READS = _struct(document_id=_S, engine=_S, priority=_I, text=_S, confidence=_D, error=_S)
READING = _struct(value=_S, value_en=_S, confidence=_D, source=_S)
MANIFEST = _struct(
    doc_id=_S, filename=_S, script_type=_S, is_synthetic=_B, seeded_error_type=_S, expected_failing_rule=_S,
    fields=_struct(property_id=_S, mutawalli_name=_S, survey_number=_S, registration_date=_S, extent=_S, village=_S),
    rendered_text=_S,
)
MODEL_ANSWER = T.StructType(
    [T.StructField(f.name, _S) for f in MANIFEST["fields"].dataType] + [T.StructField("confidence", T.MapType(_S, _D))]
)
