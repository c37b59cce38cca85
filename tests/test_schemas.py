from codeloom.operators import schemas

PROTO = '''syntax = "proto3"; // message No { int32 a = 1; }
package shop.v1;
/* message Never {
   int32 a = 1; } */
option java_package = "com.{shop}";
message Part {
  option deprecated = 5;
  int32 id = 1;
  string name = 2 [deprecated = true];
  message Line {
    oneof kind { string a = 2; Deep b = 3; }
    message Deep { map<string, int32> m = 1; }
    int32 qty = 1;
  }
  enum State { A = 0; B = 1; }
  repeated Line lines = 3; reserved 4, 5;
}
message Empty {}
service Parts { rpc Get (Part) returns (Empty) {} }
'''
THRIFT = '''namespace py shop.base
# struct No { 1: i32 a }
struct Item { 1: required i32 id, 2: optional string name = "}" }
union Any { 1: Item item; }
exception Gone { }
service S { Item get(1: i32 id) throws (1: Gone g) }
const map<i32, i32> M = { 1: 2 }
'''


def test_messages(corpus):
    found = schemas.messages(corpus({"api/part.proto": PROTO, "item.thrift": THRIFT, "x.py": PROTO, "open.proto": "message A { int32 a = 1;"}))
    assert sorted((r["path"], r["package"], r["message"], r["n_fields"]) for r in found.collect()) == [
        ("api/part.proto", "shop.v1", "Empty", 0), ("api/part.proto", "shop.v1", "Part", 3),
        ("api/part.proto", "shop.v1", "Part.Line", 3), ("api/part.proto", "shop.v1", "Part.Line.Deep", 1),
        ("item.thrift", "shop.base", "Any", 1), ("item.thrift", "shop.base", "Gone", 0), ("item.thrift", "shop.base", "Item", 2),
        ("open.proto", "", "A", 1),
    ]


def test_bindings(corpus):
    head = "// Code generated by a compiler\n"
    files = [
        (1, "api/part.proto", PROTO), (1, "item.thrift", THRIFT), (2, "other.proto", PROTO),
        (1, "gen/part_pb2.py", head + "A = DESCRIPTOR.message_types_by_name['Part']\nB = x.message_types_by_name['Part']\n"),
        (1, "gen/part.pb.go", head + "type Part struct {\n}\ntype Part_Line_Deep struct {}\ntype Line struct {}\n"),
        (1, "gen/else.pb.go", head + "type Part struct {}\n"),
        (1, "hand/part.pb.go", "type Part struct {}\n"),
        (1, "j/Line.java", head + "public final class Line extends\n    com.google.protobuf.GeneratedMessageV3 {}\n"),
        (1, "c/Part.cs", head + "public sealed partial class Deep : pb::IMessage<Deep> {}\n"),
        (1, "part_pb.js", head + "proto.shop.v1.Part.Line = function(opt) {};\nproto.Part = function(opt) {};\n"),
        (1, "gen-py/shop/ttypes.py", head + "class Item(object):\n  pass\nclass Other(object):\n  pass\n"),
        (1, "gen-java/Gone.java", head + "public class Gone implements org.apache.thrift.TBase<Gone, X> {}\n"),
        (2, "gen/other.pb.go", head + "type Part_Line struct {}\n"),
    ]
    found = schemas.schema_bindings(corpus(files))
    assert sorted((r["repo_id"], r["message"], r["n_fields"], r["convention"], r["generated_file"]) for r in found.collect()) == [
        (1, "Gone", 0, "thrift-java", "gen-java/Gone.java"), (1, "Item", 2, "thrift-python", "gen-py/shop/ttypes.py"),
        (1, "Part", 3, "proto-go", "gen/part.pb.go"), (1, "Part", 3, "proto-python", "gen/part_pb2.py"),
        (1, "Part.Line", 3, "proto-java", "j/Line.java"), (1, "Part.Line", 3, "proto-js", "part_pb.js"),
        (1, "Part.Line.Deep", 1, "proto-csharp", "c/Part.cs"), (1, "Part.Line.Deep", 1, "proto-go", "gen/part.pb.go"),
        (2, "Part.Line", 3, "proto-go", "gen/other.pb.go"),
    ]
