"""Table schemas, access-flag bits and codes."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"long": LongType(), "string": StringType(), "bool": BooleanType(), "int": IntegerType()}


def _struct(text: str) -> StructType:
    return StructType([StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in text.split())])


# Access-flag bits in the order of their names, from bit 1.
FLAG_NAMES = (
    "PUBLIC", "PRIVATE", "PROTECTED", "STATIC", "FINAL", "SYNCHRONIZED", "BRIDGE", "VARARGS", "NATIVE", "ABSTRACT", "STRICTFP", "SYNTHETIC", "ENUM", "ANNOTATION", "INTERFACE",
)
FLAGS = {name: 2 << i for i, name in enumerate(FLAG_NAMES)}
PUBLIC, ABSTRACT, INTERFACE = FLAGS["PUBLIC"], FLAGS["ABSTRACT"], FLAGS["INTERFACE"]
ALL_FLAGS = sum(FLAGS.values())

FRAMEWORK = "framework"
READ, WRITE = 0, 1
TRUE, FALSE, UNKNOWN = 1, -1, 0

#: Headerless fact files, by kind, in the order in which they depend on each other.
FACTS = {
    "classes": _struct("class:string flags:long"),
    "supers": _struct("child:string parent:string"),
    "interfaces": _struct("class:string interface:string"),
    "class_fields": _struct("class:string name:string ty:string flags:long"),
    "methods": _struct("class:string name:string args:string ret:string flags:long"),
    "calls": _struct("caller_class:string caller_name:string caller_args:string callee_class:string callee_name:string callee_args:string"),
    "method_field_access": _struct("field_class:string field_name:string field_ty:string method_class:string method_name:string method_args:string action:int"),
    "strings": _struct("string:string"),
    "method_strings": _struct("string:string method:string args:string class:string"),
}
#: Of these kinds repeated rows are written once.
DISTINCT_FACTS = ("calls", "method_field_access", "strings", "method_strings")

GRAPH = {
    "sources": _struct("id:long name:string"),
    "classes": _struct("id:long name:string access_flags:long source:long"),
    "methods": _struct("id:long class:long name:string args:string ret:string access_flags:long source:long"),
    "supers": _struct("parent:long child:long source:long"),
    "interfaces": _struct("interface:long class:long source:long"),
    "calls": _struct("caller:long callee:long source:long"),
    "strings": _struct("id:long string:string source:long"),
    "method_strings": _struct("string:long method:long"),
    "class_fields": _struct("id:long class:long name:string ty:string access_flags:long"),
    "method_field_access": _struct("field:long method:long action:int"),
}

_COMPONENT = "id:long class_name:string permission:string exported:bool enabled:bool pkg:string apk_id:long"
INVENTORY = {
    "apks": _struct("id:long app_name:string name:string is_debuggable:bool is_priv:bool device_path:string"),
    "receivers": _struct(_COMPONENT),
    "activities": _struct(_COMPONENT),
    "services": _struct(_COMPONENT + " returns_binder:int"),
    "providers": _struct("id:long name:string authorities:string permission:string grant_uri_permissions:bool read_permission:string write_permission:string exported:bool enabled:bool apk_id:long"),
    "permissions": _struct("id:long name:string protection_level:string source_apk_id:long"),
    "apk_permissions": _struct("id:long name:string apk_id:long"),
    "protected_broadcasts": _struct("id:long name:string"),
    "system_services": _struct("id:long name:string iface:string can_get_binder:int"),
    "system_service_impls": _struct("id:long system_service_id:long source:string class_name:string"),
    "system_service_methods": _struct("id:long system_service_id:long transaction_id:long name:string signature:string return_type:string method_hash:string"),
    "device_properties": _struct("id:long name:string value:string"),
    "fuzz_results": _struct("id:long service_name:string method_name:string exception_thrown:bool security_exception_thrown:bool"),
}
